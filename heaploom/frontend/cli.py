"""The command line: ``python -m heaploom COMMAND FILE ...``, ``shell FILE``, ``serve``."""

from __future__ import annotations

import argparse
import cmd
import shlex
import sys

from pyspark.sql import SparkSession

from heaploom.frontend import server
from heaploom.frontend.commands import COMMANDS, Command, json_of, text_of
from heaploom.snapshot import Snapshot


def _options(parser: argparse.ArgumentParser, command: Command) -> None:
    if command.objects:
        parser.add_argument("object_id", help="an object, like @12345")
    for o in command.options:
        flag = "--" + o.name.replace("_", "-")
        if o.kind is bool:
            parser.add_argument(flag, dest=o.name, action="store_true", help=o.help)
        else:
            parser.add_argument(flag, dest=o.name, type=o.kind, action="append" if o.many else "store", help=o.help)
    parser.add_argument("--rows", type=int, default=100, help="rows printed at most")
    parser.add_argument("--json", action="store_true", help="print a line of JSON for each row")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="heaploom", description="Queries over snapshots of heaps.")
    sub = p.add_subparsers(dest="command", required=True)
    for command in COMMANDS.values():
        one = sub.add_parser(command.name, help=command.help)
        one.add_argument("file", help="a snapshot file, at any path that Spark reads")
        if command.other:
            one.add_argument("baseline", help="the earlier snapshot")
        one.add_argument("--weak-is-reachable", action="store_true", help="let weak edges count for distances")
        _options(one, command)
    shell = sub.add_parser("shell", help="many commands on one file")
    shell.add_argument("file")
    shell.add_argument("--weak-is-reachable", action="store_true")
    sub.add_parser("serve", help="tools over standard input and output")
    return p


def answer(command: Command, snapshot: Snapshot, given: dict, baseline: Snapshot | None = None) -> str:
    names = [o.name for o in command.options] + (["object_id"] if command.objects else [])
    parts = command.answer(snapshot, **{n: given[n] for n in names}, **({"baseline": baseline} if command.other else {}))
    return (json_of if given["json"] else text_of)(parts, given["rows"])


class Shell(cmd.Cmd):
    """Commands on one loaded snapshot; its analysis is kept between them."""

    prompt = "heaploom> "

    def __init__(self, snapshot: Snapshot, **streams: object) -> None:
        super().__init__(**streams)
        self.snapshot, self.loaded = snapshot, {}

    def default(self, line: str) -> bool | None:
        if line.strip() in ("exit", "quit", "EOF"):
            return True
        name, *rest = shlex.split(line)
        command = COMMANDS.get(name)
        if command is None:
            print(f"no command {name!r}; there are {', '.join(COMMANDS)}, quit", file=self.stdout)
            return None
        p = argparse.ArgumentParser(prog=name)
        if command.other:
            p.add_argument("baseline")
        _options(p, command)
        try:
            given = vars(p.parse_args(rest))
            baseline = None
            if command.other:
                path = given["baseline"]
                baseline = self.loaded.setdefault(path, None) or Snapshot.load(self.snapshot.spark, path)
                self.loaded[path] = baseline
            print(answer(command, self.snapshot, given, baseline), file=self.stdout)
        except SystemExit:
            pass
        except (KeyError, ValueError) as e:
            print(e.args[0], file=self.stdout)
        return None

    def do_help(self, arg: str) -> None:
        for c in COMMANDS.values():
            print(f"{c.name:16} {c.help}", file=self.stdout)

    def emptyline(self) -> bool:
        return False


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    name = given["command"]
    if name == "serve":
        server.serve(spark, sys.stdin, sys.stdout)
        return 0
    try:
        snapshot = Snapshot.load(spark, given["file"], given["weak_is_reachable"])
        if name == "shell":
            Shell(snapshot).cmdloop()
            return 0
        command = COMMANDS[name]
        baseline = Snapshot.load(spark, given["baseline"], given["weak_is_reachable"]) if command.other else None
        print(answer(command, snapshot, given, baseline))
    except (KeyError, ValueError) as e:
        print(e.args[0], file=sys.stderr)
        return 1
    return 0
