"""What the programs offer: each command is a query of ``Snapshot``, its options and the columns it shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.functions import formats, render
from heaploom.operators.trees import MAX_DEPTH, MAX_NODES
from heaploom.snapshot import Snapshot

#: A piece of an answer: a page of rows with the columns to show, or a line of text.
Part = tuple[DataFrame, list[str] | None] | str

EDGE = ["id", "display_name", "self_size", "retained_size", "distance"]
TREE = ["edge", *EDGE]


@dataclass(frozen=True)
class Option:
    """``many`` options may be given more than once."""

    name: str
    kind: type = str
    default: object = None
    help: str = ""
    many: bool = False


@dataclass(frozen=True)
class Command:
    """``tool`` names it for clients of the server, ``only`` lists the options these get; ``other`` asks for a second snapshot."""

    name: str
    help: str
    run: Callable[..., list[Part]]
    options: tuple[Option, ...] = ()
    objects: bool = False
    other: bool = False
    tool: str | None = None
    only: tuple[str, ...] | None = None

    def answer(self, snapshot: Snapshot, **given: object) -> list[Part]:
        values = {o.name: o.default for o in self.options} | {k: v for k, v in given.items() if v is not None}
        return self.run(snapshot, **values)


def text_of(parts: list[Part], limit: int) -> str:
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
            continue
        df, columns = p
        if columns is None and len(df.columns) > 12:
            rows = df.limit(limit).collect()
            out += ["\n".join(f"{c}: {r[c]}" for c in df.columns if r[c] is not None) for r in rows] or ["no rows"]
        elif columns and "depth" in df.columns and "path" in df.columns:
            shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
            out.append(render.tree(df.orderBy("path").withColumn("_line", F.concat_ws("  ", *shown)), "_line", limit=limit) or "no rows")
        else:
            out.append(render.table(df, [c for c in columns if c in df.columns] if columns else None, limit))
    return "\n\n".join(out)


def json_of(parts: list[Part], limit: int) -> str:
    """A line of JSON for each row; what is said besides is left out."""
    tables = [render.json_lines(p[0].select(*[c for c in p[1] if c in p[0].columns]) if p[1] and "depth" not in p[0].columns else p[0], limit) for p in parts if not isinstance(p, str)]
    return "\n".join(t for t in tables if t)


def _summary(s: Snapshot, group: str | None, expand: str | None, filter: str, filter_interval: int | None, offset: int, limit: int) -> list[Part]:  # noqa: A002
    if expand is not None:
        group, place = s.group_of(expand)
        offset = place // limit * limit
    if group is not None:
        # name:start:count asks for a window, unless a group is called so
        name, start, count = formats.parse_window(group)
        if start is not None and s.nodes.where(F.col("group_name") == group).isEmpty():
            group, offset, limit = name, start, count if count is not None else limit
        return [f"{group}, from {offset}", (s.summary_members(group, offset, limit, filter), None)]
    return [(s.summary(filter, interval=filter_interval), ["name", "count", "distance", "self_size", "retained_size"])]


def _statistics(s: Snapshot) -> list[Part]:
    return [(s.statistics(), None), (s.realm_sizes(), None)]


def _strings(s: Snapshot, min_count: int, offset: int, limit: int, show_object_ids: bool) -> list[Part]:
    return [(s.duplicate_strings(min_count, offset, limit, show_object_ids), None), "In all:", (s.duplicate_totals(min_count), None), "Strings left out:", (s.skipped_strings(), None)]


def _timeline(s: Snapshot) -> list[Part]:
    rows = s.timeline()
    return ["no timeline data in this snapshot"] if rows.isEmpty() else [(rows, ["seq", "seconds", "count", "size", "bar"]), "In all:", (s.timeline_totals(), None)]


def _object(s: Snapshot, object_id: str) -> list[Part]:
    return [(s.node(object_id).select("id", "display_name", "type", "self_size", "retained_size", "distance_text", "detachedness"), None)]


def _show(s: Snapshot, object_id: str, depth: int, offset: int, limit: int) -> list[Part]:
    out = _object(s, object_id)
    stack, source = s.allocation_stack(object_id), s.function_source(object_id)
    if not stack.isEmpty():
        out += ["Allocated at:", (stack.select("frame_no", "function_name", "script_name", "line", "col"), None)]
    if source:
        out += ["Source:", source]
    return [*out, (s.show(object_id, depth, offset, limit), TREE)]


def _show_retainers(s: Snapshot, object_id: str, depth: int, offset: int, limit: int) -> list[Part]:
    return [*_object(s, object_id), (s.show_retainers(object_id, depth, offset, limit), TREE)]


def _retainers(s: Snapshot, object_id: str, max_depth: int, max_nodes: int) -> list[Part]:
    rows = s.retaining_paths(object_id, max_depth, max_nodes)
    facts = rows.select("reached", "truncated").first()
    if facts is None or not facts["reached"]:
        return _object(s, object_id) + ["no path to a root was found within the limits"]
    named = rows.join(s.nodes.select(F.col("ord").alias("retainer"), "id", "display_name"), "retainer")
    named = named.join(s.edges.select("eid", "type", F.coalesce("name", F.col("idx").cast("string")).alias("edge")), "eid")
    out = _object(s, object_id) + [(named.withColumn("path", F.col("path_seq")).orderBy("path_seq"), ["edge", "id", "display_name", "distance"])]
    return out + (["the search stopped at its limits; there may be more paths"] if facts["truncated"] else [])


def _retainers_of(s: Snapshot, object_id: str, offset: int, limit: int, max_depth: int, max_nodes: int) -> list[Part]:
    rows = s.retainers_report(object_id, offset, limit, max_depth, max_nodes)
    return [*_object(s, object_id), (rows, ["rank", "depth", "on_plan", "edge", "id", "display_name", "distance"])]


def _search(s: Snapshot, text: str) -> list[Part]:
    found = s.search(text)
    return ["nothing asked for"] if found is None else [(found, ["id", "display_name"] if "display_name" in found.columns else ["name", "count", "self_size", "retained_size"])]


def _containment(s: Snapshot, depth: int, expand: list[str] | None, limit: int) -> list[Part]:
    return [(s.containment(None, max(depth, 1), {i: (0, limit) for i in expand or []}), TREE)]


def _diff(s: Snapshot, baseline: Snapshot, group: str | None, offset: int, limit: int) -> list[Part]:
    return [(s.diff(baseline) if group is None else s.diff_members(baseline, group, offset, limit), None)]


def _reachable(s: Snapshot, object_id: str) -> list[Part]:
    return [(s.reachable_size(object_id), None)]


def _page(limit: int) -> tuple[Option, Option]:
    return Option("offset", int, 0, "rows to skip"), Option("limit", int, limit, "rows to show")


DEPTH = Option("depth", int, 1, "levels to open")
FLAGS = tuple(Option(n, bool, False, f"also {n}") for n in ("builtins", "templates", "extensions"))
INCOMPLETE = Option("show_incomplete", bool, False, "also contexts of which some closure has no source")
GROUP = Option("group", str, None, "name of a constructor group to open")

COMMANDS: dict[str, Command] = {
    c.name: c
    for c in (
        Command("summary", "objects by constructor, or the objects of one", _summary, (GROUP, Option("expand", str, None, "open the group that holds this object"), Option("filter", str, "all", f"one of {', '.join(Snapshot.filters)}"), Option("filter_interval", int, None, "objects of this interval of the timeline"), *_page(20)), tool="get_summary", only=("group", "filter", "filter_interval", "offset", "limit")),
        Command("statistics", "sizes by kind and by realm", _statistics, tool="get_statistics"),
        Command("timeline", "live objects by time of allocation", _timeline, tool="get_timeline"),
        Command("strings", "strings that are held more than once", _strings, (Option("min_count", int, 2, "copies at least"), *_page(100), Option("show_object_ids", bool, False, "list the ids")), tool="get_duplicate_strings", only=("offset", "limit", "show_object_ids")),
        Command("retainers", "paths that keep an object alive", _retainers, (Option("max_depth", int, MAX_DEPTH, "levels searched"), Option("max_nodes", int, MAX_NODES, "objects searched")), objects=True, tool="get_retaining_paths"),
        Command("containment", "the tree from the roots", _containment, (DEPTH, Option("expand", str, None, "also open this object", many=True), Option("limit", int, 10, "rows of an opened object")), tool="get_containment", only=()),
        Command("realms", "realms with sizes and their own global names", lambda s: [(s.realms().select("label", "id", "kind", "detachedness", "self_size", "retained_size", "reachable_size", *[c for c in s.realms().columns if c.endswith("vars")]), None)], tool="get_native_contexts"),
        Command("contexts", "closure contexts and the variables that hold most", lambda s, **o: [(s.contexts(**o), None)], (Option("min_retained", str, "8K", "least size of a context"), Option("min_var_retained", str, "1K", "least size of a variable"))),
        Command("stack", "what the stack and handle scopes hold", lambda s, **o: [(s.stack_roots(**o), None)], (Option("min_reachable_mb", float, None, "least reachable size"),)),
        Command("show", "an object and what it refers to", _show, (DEPTH, *_page(100)), objects=True, tool="show"),
        Command("show-retainers", "an object and what refers to it", _show_retainers, (DEPTH, *_page(100)), objects=True, tool="show_retainers"),
        Command("closure-leaks", "context variables that no live closure uses", lambda s, show_incomplete: [(s.closure_leaks(show_incomplete), None)], (INCOMPLETE,), tool="get_closure_leaks"),
        Command("closures", "closures by what they retain", lambda s, **o: [(s.closures(**o), None)], (*_page(100), *FLAGS, Option("realm", int, None, "only of this realm"))),
        Command("context-tree", "contexts under a context, with closures and unused variables", lambda s, object_id: [(s.context_tree(object_id), ["ctx", "n_closures", "unused"])], objects=True),
        Command("scopes", "scopes of a script or function", lambda s, object_id: [(s.scopes(object_id), None)], objects=True),
        Command("roots", "system and user roots and the categories of GC roots", lambda s: [(s.roots(), None)]),
        Command("diff", "what was added and freed since a baseline", _diff, (GROUP, *_page(20)), other=True, tool="compare_snapshots"),
        Command("dominators", "the chain of dominators of an object", lambda s, object_id: [(s.dominators_of(object_id).select(*EDGE), None)], objects=True, tool="get_dominators_of"),
        Command("info", "all that is known of an object", lambda s, object_id: [(s.node_info(object_id), None)], objects=True, tool="get_node_info"),
        Command("direct-retainers", "what refers to an object, paths to roots first and opened", _retainers_of, (*_page(10), Option("max_depth", int, MAX_DEPTH, "levels searched"), Option("max_nodes", int, MAX_NODES, "objects searched")), objects=True),
        Command("reveal", "the steps and pages that show an object in a view", lambda s, object_id, view: [(s.reveal(object_id, view), None)], (Option("view", str, "containment", "containment, dominators or summary"),), objects=True),
        Command("search", "an object by @id, or groups by name", _search, (Option("text", str, "", "what to look for"),)),
        Command("reachable", "the size of all that an object reaches", _reachable, objects=True, tool="get_reachable_size"),
    )
}
