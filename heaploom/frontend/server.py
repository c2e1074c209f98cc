"""A Model Context Protocol server: JSON-RPC 2.0, a line per message, on standard input and output."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import SparkSession

from heaploom.frontend.commands import COMMANDS, Command, Option, text_of
from heaploom.snapshot import Registry

#: Fixed values of the protocol.
VERSION = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS = -32700, -32600, -32601, -32602
TYPES = {str: "string", int: "integer", float: "number", bool: "boolean"}

#: What options are called by clients.
RENAMED = {"group": "class_name"}
SNAPSHOT = {"snapshot_id": {"type": "integer", "description": "number of a loaded snapshot"}}


def _offered(command: Command) -> list[Option]:
    return [o for o in command.options if command.only is None or o.name in command.only]


def _schema(command: Command) -> dict:
    fields, needed = dict(SNAPSHOT), ["snapshot_id"]
    if command.other:
        fields["baseline_id"] = {"type": "integer", "description": "number of the earlier snapshot"}
        needed.append("baseline_id")
    if command.objects:
        fields["object_id"] = {"type": "string", "description": "an object, like @12345"}
        needed.append("object_id")
    for o in _offered(command):
        fields[RENAMED.get(o.name, o.name)] = {"type": TYPES[o.kind], "description": o.help}
    return {"type": "object", "properties": fields, "required": needed}


def tools() -> list[dict]:
    path = {"type": "object", "properties": {"path": {"type": "string", "description": "path of a .heapsnapshot file"}}, "required": ["path"]}
    own = [
        {"name": "load_snapshot", "description": "load a snapshot and return its number", "inputSchema": path},
        {"name": "close_snapshot", "description": "forget a snapshot", "inputSchema": {"type": "object", "properties": SNAPSHOT, "required": ["snapshot_id"]}},
    ]
    return own + [{"name": c.tool, "description": c.help, "inputSchema": _schema(c)} for c in COMMANDS.values() if c.tool]


class Server:
    def __init__(self, spark: SparkSession, rows: int = 100) -> None:
        self.registry, self.rows = Registry(spark), rows
        self.commands = {c.tool: c for c in COMMANDS.values() if c.tool}

    def call(self, name: str, given: dict) -> str:
        """The text of a tool's answer; KeyError and ValueError say what is wrong with the call."""
        if name == "load_snapshot":
            number = self.registry.load(given["path"])
            count = self.registry.get(number).info["node_count"]
            return f"loaded {given['path']} with {count} nodes; snapshot_id: {number}"
        if name == "close_snapshot":
            number = given["snapshot_id"]
            return f"closed snapshot {number}" if self.registry.close(number) else f"no snapshot with id {number}"
        command = self.commands[name]
        values = {o.name: given.get(RENAMED.get(o.name, o.name)) for o in _offered(command)}
        if command.objects:
            values["object_id"] = given["object_id"]
        if command.other:
            values["baseline"] = self.registry.get(given["baseline_id"])
        if name == "get_containment":
            roots = self.registry.get(given["snapshot_id"]).containment_roots()
            return text_of([(roots, None)], self.rows)
        return text_of(command.answer(self.registry.get(given["snapshot_id"]), **values), self.rows)

    def _tool(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        known = {t["name"]: t["inputSchema"] for t in tools()}
        if name not in known:
            raise LookupError(f"no tool {name!r}")
        missing = [k for k in known[name]["required"] if k not in given]
        strange = [k for k in given if k not in known[name]["properties"]]
        if missing or strange:
            raise LookupError(f"missing: {', '.join(missing) or 'none'}; unknown: {', '.join(strange) or 'none'}")
        try:
            return {"content": [{"type": "text", "text": self.call(name, given)}], "isError": False}
        except Exception as e:  # noqa: BLE001 - a failed query is an answer; the server goes on
            return {"content": [{"type": "text", "text": str(e.args[0] if e.args else e)}], "isError": True}

    def handle(self, message: object) -> dict | None:
        """The reply to a message; None for notifications."""
        if not isinstance(message, dict) or "method" not in message:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "not a request"}}
        if "id" not in message:
            return None
        method, params = message["method"], message.get("params") or {}
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            if method == "initialize":
                return reply | {"result": {"protocolVersion": params.get("protocolVersion", VERSION), "capabilities": {"tools": {}}, "serverInfo": {"name": "heaploom", "version": "1"}}}
            if method == "ping":
                return reply | {"result": {}}
            if method == "tools/list":
                return reply | {"result": {"tools": tools()}}
            if method == "tools/call":
                return reply | {"result": self._tool(params)}
        except LookupError as e:
            return reply | {"error": {"code": INVALID_PARAMS, "message": e.args[0]}}
        return reply | {"error": {"code": NO_METHOD, "message": f"no method {method!r}"}}


def serve(spark: SparkSession, source: TextIO, sink: TextIO) -> None:
    server = Server(spark)
    for line in source:
        if not line.strip():
            continue
        try:
            reply = server.handle(json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply), file=sink, flush=True)
