"""Programs over the queries of a snapshot: command line, tool server, interactive shell."""
