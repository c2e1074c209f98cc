"""Command line, tool server and shell over one small file."""

import io
import json

import pytest

from heaploom.frontend import server
from heaploom.frontend.cli import Shell, main
from heaploom.frontend.commands import COMMANDS
from heaploom.snapshot import Snapshot
from tests.test_snapshot import app


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    path = tmp_path_factory.mktemp("front") / "a.heapsnapshot"
    heap = app()
    path.write_bytes(heap.content())
    return str(path), heap


@pytest.fixture(scope="module")
def loaded(spark, at):
    return Snapshot.load(spark, at[0])


def arguments(command, heap):
    which = {"context-tree": "ctx", "scopes": "sfi"}.get(command.name, "B")
    return {"object_id": f"@{heap.id(which)}"} if command.objects else {}


@pytest.mark.parametrize("name", COMMANDS)
def test_every_command_answers(loaded, at, name):
    from heaploom.frontend.commands import json_of, text_of

    command = COMMANDS[name]
    more = {"baseline": loaded} if command.other else {}
    parts = command.answer(loaded, **arguments(command, at[1]), **more)
    assert text_of(parts, 20)
    for line in json_of(parts, 20).splitlines():
        json.loads(line)


def test_command_line(spark, at, capsys):
    path, heap = at
    assert main(["summary", path], spark) == 0
    assert "Foo" in capsys.readouterr().out
    assert main(["summary", path, "--group", "Foo", "--json"], spark) == 0
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == [heap.id("B")]
    assert main(["summary", path, "--group", "Foo:0:1", "--json"], spark) == 0
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == [heap.id("B")]
    # A has a source position, so it is in a group of its own, which it names.
    assert main(["summary", path, "--expand", f"@{heap.id('A')}", "--json"], spark) == 0
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == [heap.id("A")]
    assert main(["show", path, "@999999"], spark) == 1
    assert "@999999" in capsys.readouterr().err
    assert main(["summary", path, "--filter", "nope"], spark) == 1
    assert "valid filters" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["nonsense", path], spark)


def test_server(spark, at):
    path, heap = at
    def ask(n, tool, **given):
        return {"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": tool, "arguments": given}}

    sent = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2025-06-18"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        ask(3, "load_snapshot", path=path),
        ask(4, "get_summary", snapshot_id=1, class_name="Foo"),
        ask(5, "get_retaining_paths", snapshot_id=1, object_id=f"@{heap.id('B')}"),
        ask(6, "show", snapshot_id=1, object_id="twelve"),
        ask(7, "get_containment", snapshot_id=1),
        ask(8, "close_snapshot", snapshot_id=1),
        ask(9, "get_statistics", snapshot_id=1),
        ask(10, "show", snapshot_id=1),
        ask(11, "no_such_tool"),
        {"jsonrpc": "2.0", "id": 12, "method": "nothing"},
    ]
    out = io.StringIO()
    server.serve(spark, io.StringIO("\n".join([*map(json.dumps, sent), "{broken", "[]"])), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    by_id = {r["id"]: r for r in replies if r["id"] is not None}
    assert by_id[1]["result"]["protocolVersion"] == "2025-06-18"
    assert len(by_id[2]["result"]["tools"]) == 16
    text = {n: r["result"]["content"][0]["text"] for n, r in by_id.items() if n in range(3, 10)}
    assert text[3].endswith("snapshot_id: 1")
    assert text[4].splitlines()[-1] == "1–1 of 1" and "(GC roots)" in text[7]
    # Paths end at what the GC roots hold, here A.
    assert text[5].splitlines()[-1].split() == ["B", str(heap.id("A")), "Foo", "1"]
    assert by_id[6]["result"]["isError"] and "@12345" in text[6]
    assert text[8] == "closed snapshot 1" and by_id[9]["result"]["isError"] and "no snapshot with id 1" in text[9]
    assert by_id[10]["error"]["code"] == by_id[11]["error"]["code"] == server.INVALID_PARAMS
    assert by_id[12]["error"]["code"] == server.NO_METHOD
    assert [r["error"]["code"] for r in replies if r["id"] is None] == [server.PARSE_ERROR, server.INVALID_REQUEST]


def test_shell(loaded, at):
    out = io.StringIO()
    sh = Shell(loaded, stdout=out)
    for line in ("", "help", f"show @{at[1].id('A')} --depth 2", "nonsense", "show twelve", "summary --limit x"):
        assert not sh.onecmd(line)
    assert "Foo" in out.getvalue() and "no command 'nonsense'" in out.getvalue() and "@12345" in out.getvalue()
    assert sh.onecmd("quit")
