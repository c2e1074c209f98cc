"""The façade over whole files."""

import pytest

from heaploom.operators import locations
from heaploom.snapshot import History, Registry, Snapshot
from heaploom.sources import heapsnapshot
from tests.graphs import Heap

SCRIPT = "function outer(){ let used = 1, idle = 2; function f(){ return used } return f }"


def app():
    h = Heap(detachedness=True, traced=True)
    h.add("A", size=100, name="Foo", trace=3).add("B", size=50, name="Foo", trace=4).add("arr", "array", "", 200).add("zero", size=0, name="Zero")
    h.chain("R", "A", "B").link("R", "arr").link("R", "zero")
    for i in (1, 2):
        h.add(f"s{i}", "string", "same", 20).add(f"n{i}", "number", "int", 0).add(f"v{i}", "string", "4", 0)
        h.link("A", f"s{i}").link(f"s{i}", f"n{i}", "internal", "length").link(f"n{i}", f"v{i}", "internal", "value")
    h.add("bare", "string", "same", 20).link("A", "bare")
    h.add("cons", "concatenated string", "", 8).add("left", "string", "ab", 8).add("right", "string", "cd", 8)
    h.link("A", "cons").link("cons", "left", "internal", "first").link("cons", "right", "internal", "second")
    h.add("plain", "object", "Object", 16).link("A", "plain").link("plain", "left", "property", "x").link("plain", "right", "property", "y z")
    h.add("realm", "object", "system / NativeContext / https://x").link("R", "realm")
    h.add("ctx", "object", "system / Context", 30).add("used").add("idle", size=40).add("f", "closure", "f", 10).add("sfi", "code", "system / SharedFunctionInfo / f", 5)
    h.add("script", "code", "system / Script / /app/a.js", 5).add("src", "string", SCRIPT, 0)
    h.link("ctx", "realm", "internal", "previous").link("ctx", "used", "context", "used").link("ctx", "idle", "context", "idle")
    h.link("R", "f").link("f", "ctx", "internal", "context").link("f", "sfi", "internal", "shared").link("sfi", "script", "internal", "script").link("script", "src", "internal", "source")
    for name, value in (("start_position", SCRIPT.index("function f")), ("end_position", SCRIPT.index(" return f"))):
        h.add(name, "number", "int").add(name + "v", "string", str(value)).link("sfi", name, "internal", name).link(name, name + "v", "internal", "value")
    h.add("w", size=3).link("A", "w", "weak")
    for name, kind, value in (("smi", "smi number", "7"), ("dbl", "heap number", "1.5")):
        h.add(name, "number", kind, 0).add(name + "v", "string", value, 0).link("A", name).link(name, name + "v", "internal", "value")
    h.add("map", "object", "system / Map", 0).add("itype", "string", "JS_OBJECT_TYPE", 0).link("A", "map", "internal", "map").link("map", "itype", "internal", "instance_type_name")
    h.add("scope", "code", "system / ScopeInfo", 0).add("inner", "code", "system / ScopeInfo", 0).add("stype", "string", "SCRIPT_SCOPE", 0).add("ftype", "string", "FUNCTION_SCOPE", 0)
    h.link("sfi", "scope", "internal", "raw_outer_scope_info_or_feedback_metadata").link("scope", "stype", "internal", "scope_type_name").link("inner", "scope", "internal", "outer_scope_info").link("inner", "ftype", "internal", "scope_type_name").link("ctx", "inner", "internal", "scope_info").link("sfi", "inner", "internal", "name_or_scope_info")
    h.more = {
        "sample_fields": ["timestamp_us", "last_assigned_id"], "samples": [50000, 5, 100000, 9],
        "location_fields": ["object_index", "script_id", "line", "column"], "locations": ["A", 7, 1, 2, "A", 7, 3, 4, "sfi", 7, 0, SCRIPT.index("f(){ return used")],
        "trace_function_info_fields": ["function_id", "name", "script_name", "script_id", "line", "column"],
        "trace_function_infos": [0, "(root)", "", 0, 0, 0, 1, "main", "a.js", 7, 1, 1, 2, "alloc", "a.js", 7, 2, 2],
        "trace_node_fields": ["id", "function_info_index", "count", "size", "children"], "trace_tree": [1, 0, 0, 0, [2, 1, 0, 0, [3, 2, 1, 1, [], 4, 2, 1, 1, []]]],
    }
    return h


@pytest.fixture(scope="module")
def heap():
    return app()


@pytest.fixture(scope="module")
def snap(spark, heap, tmp_path_factory):
    path = tmp_path_factory.mktemp("heap") / "a.heapsnapshot"
    path.write_bytes(heap.content())
    return Snapshot.load(spark, str(path))


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_tables_round_trip(spark, heap, tmp_path):
    path = tmp_path / "b.heapsnapshot"
    path.write_bytes(heap.content())
    heapsnapshot.register(spark)
    nodes = spark.read.format("heapsnapshot").option("table", "nodes").load(str(path))
    edges = spark.read.format("heapsnapshot").option("table", "edges").load(str(path))
    assert rows(nodes.orderBy("ord"), "type", "name", "id", "self_size") == [n[:4] for n in heap.nodes]
    want = sorted((a, b, k, None if k == "element" else n) for a, b, k, n in heap.edges)
    assert sorted(rows(edges, "src", "dst", "type", "name"), key=str) == sorted(want, key=str)
    held = heapsnapshot.tables_from_bytes(spark, heap.content())
    assert held["nodes"].count() == len(heap.nodes) and held["samples"].count() == 2


@pytest.mark.parametrize("change", ["nodes", "edges"])
def test_broken_files_are_refused(heap, change):
    import json

    raw = json.loads(heap.content())
    raw[change] = raw[change][:-1]
    with pytest.raises(ValueError):
        heapsnapshot.Snapshot(json.dumps(raw).encode())
    raw = json.loads(heap.content())
    raw["nodes"][0] = -1
    with pytest.raises(ValueError, match="negative"):
        heapsnapshot.Snapshot(json.dumps(raw).encode())


def test_summary(snap):
    got = {r["name"]: r for r in snap.summary().collect()}
    located = got["Foo [a.js:4:5]"]
    assert (located["count"], located["self_size"]) == (1, 100) and got["Foo"]["self_size"] == 50
    assert "Zero" not in got and got["(array)"]["retained_size"] == 200
    with pytest.raises(ValueError, match="valid filters"):
        snap.summary("nonsense")
    assert rows(snap.summary("unreachable"), "name", "self_size") == [("w", 3)]
    assert [r["id"] for r in snap.summary_members("Foo").collect()] == [snap.nodes.where("name = 'Foo' and self_size = 50").first()["id"]]
    with pytest.raises(KeyError):
        snap.summary_members("Nobody")
    assert snap.group_of(snap.nodes.where("type = 'array'").first()["id"]) == ("(array)", 0)


def test_totals_agree(snap):
    s = snap.statistics().first()
    assert s["total"] == s["v8_total"] + s["native_total"] == snap.nodes.agg({"self_size": "sum"}).first()[0]
    assert s["strings"] == 20 * 3 + 8 * 3
    assert sum(r["size"] for r in snap.realm_sizes().collect()) == s["total"]


def test_strings(snap):
    got = snap.duplicate_strings(show_ids=True).collect()
    assert [(r["value"], r["count"], r["wasted"], r["length"]) for r in got] == [("same", 2, 20, 4)] and len(got[0]["ids"]) == 2
    skipped = snap.skipped_strings().first()
    assert skipped["skipped_count"] >= 1
    names = {r["name"]: r["display_name"] for r in snap.nodes.where("type = 'closure'").collect()}
    assert names == {"f": "f [JSFunction]"}
    shown = {r["display_name"] for r in snap.nodes.collect()}
    assert {"abcd", '{x, y z}', "int 4", "smi 7", "double 1.5"} <= shown


def test_timeline_and_intervals(snap):
    got = rows(snap.timeline(), "id_from", "id_to", "count", "size")
    assert got == [(0, 5, 1, 100), (5, 9, 2, 250)]
    assert {r["name"] for r in snap.summary(interval=1).collect()} == {"Foo", "(array)"}
    with pytest.raises(ValueError, match="interval"):
        snap.summary(interval=9)


def test_diff(spark, snap, heap):
    other = app().add("extra", size=11, name="Fresh", id=9001).link("R", "extra")
    b = Snapshot.from_bytes(spark, other.content())
    assert rows(b.diff(snap), "name", "new", "deleted", "size_delta") == [("Fresh", 1, 0, 11)]
    assert rows(snap.diff(b), "name", "new", "deleted", "size_delta") == [("Fresh", 0, 1, -11)]
    assert snap.diff(snap).count() == 0
    assert rows(b.diff_members(snap, "Fresh"), "sign", "id") == [("+", 9001)]
    with pytest.raises(KeyError):
        b.diff_members(snap, "Foo")


def test_trees(snap, heap):
    a, b = heap.id("A"), heap.id("B")
    assert rows(snap.dominators_of(b), "id") == [(b,), (a,), (heap.id("R"),)]
    assert rows(snap.children(a, limit=2), "id") == [(b,), (heap.id("s1"),)]
    assert rows(snap.retainers(b), "id") == [(a,)]
    assert rows(snap.children(a, text="S2"), "id") == [(heap.id("s2"),)]
    assert {r["id"] for r in snap.show(a, depth=2).collect()} >= {b, heap.id("n1")}
    assert {r["id"] for r in snap.show_retainers(b, depth=2).collect()} == {a, heap.id("R")}
    assert snap.containment(depth=1).count() == 5
    assert rows(snap.reveal(b).join(snap.nodes, "ord").orderBy("step"), "id") == [(heap.id("R"),), (a,), (b,)]
    assert rows(snap.dominated_children(heap.id("R"), limit=1), "id") == [(a,)]
    assert snap.roots().count() >= 5 and snap.containment_roots().count() >= 5
    with pytest.raises(KeyError):
        snap.node(999999)


def test_retaining_paths(snap, heap):
    plan = snap.retaining_plan(heap.id("B"))
    assert plan.reached and [r[3] for r in plan.rows] == [heap.names["A"]]
    assert snap.retaining_paths(heap.id("s1")).first()["reached"]
    assert not snap.retaining_plan(heap.id("w")).reached


def test_reach(snap, heap):
    got = {r["root"]: r["size"] for r in snap.reachable_size(heap.id("A"), heap.id("B")).collect()}
    assert got == {heap.names["A"]: 100 + 50 + 60 + 24 + 16, heap.names["B"]: 50}


def test_closures_and_contexts(snap, heap):
    leak = snap.closure_leaks().collect()
    assert [(r["var"], r["target_id"]) for r in leak] == [("idle", heap.id("idle"))]
    assert rows(snap.closures(), "name", "builtin") == [("f", False)]
    assert snap.function_source(heap.id("f")) == "function f(){ return used }"
    assert rows(snap.contexts(min_retained=1, min_var_retained=1), "count") == [(1,)]
    tree = snap.context_tree(heap.id("realm")).collect()
    assert [(r["depth"], r["n_closures"]) for r in tree] == [(0, 0), (1, 1)] and tree[1]["unused"] == ["idle"]
    with pytest.raises(ValueError, match="context"):
        snap.context_tree(heap.id("A"))
    assert [r["name"] for r in snap.scopes(heap.id("script")).collect()] == ["outer", "f"]
    assert rows(snap.realms(), "label", "kind") == [(f"[utility] #0 https://x @{heap.id('realm')}", "utility")]


def test_allocation_stack(snap, heap):
    assert rows(snap.allocation_stack(heap.id("A")), "frame_no", "function_name") == [(0, "alloc"), (1, "main")]
    assert snap.allocation_stack(heap.id("arr")).count() == 0


def test_registry_and_history(spark, heap, tmp_path):
    path = tmp_path / "c.heapsnapshot"
    path.write_bytes(heap.content())
    r = Registry(spark)
    n = r.load(str(path))
    assert (n, r.close(n), r.close(n)) == (1, True, False)
    with pytest.raises(KeyError, match="no snapshot"):
        r.get(n)
    h = History(spark, str(tmp_path / "history"))
    h.save(heap.content(), [5, 3], {3: 8})
    assert rows(h.load(heap.content()), "id", "reachable_size") == [(5, None), (3, 8)] and h.load(b"other") is None


def test_retained_only_filters(spark):
    h = Heap(detachedness=True).add("det", "native", "Node", 7, det=2).add("under", size=5).add("console", "synthetic", "", 0).add("log", size=9)
    h.chain("R", "det", "under").link("root", "console").link("console", "log", "internal", "1 / DevTools console")
    h.add("listener", "native", "V8EventListener").add("cb", "closure", "cb", 4).add("code", "code", "c", 2).link("R", "listener").link("listener", "cb", "internal", "callback_object_").link("cb", "code", "internal", "code")
    s = Snapshot.from_bytes(spark, h.content())
    names = lambda f: {r["name"] for r in s._filter(f).collect()}
    assert names("detached-dom") == {"Node", "under"}
    assert names("console") == {"log"}
    assert names("event-handlers") == {"cb", "c"}


def test_locations_and_scope_names(snap, heap):
    at = {r["ord"]: r["location"] for r in snap.locations().collect()}
    column = SCRIPT.index("f(){ return used") + 1
    assert at[heap.names["A"]] == "a.js:4:5" and at[heap.names["f"]] == at[heap.names["sfi"]] == f"a.js:1:{column}"
    assert {r["scope"]: r["scope_name"] for r in snap.scope_names().collect()} == {heap.names["scope"]: "/app/a.js", heap.names["inner"]: "f"}
    assert rows(snap.context_locations(), "ctx", "location") == [(heap.names["ctx"], f"a.js:1:{column}")]
    ends = {r["ord"]: (r["line"], r["col"]) for r in locations.function_ends(snap.nodes, snap.edges).collect()}
    assert ends == dict.fromkeys((heap.names["f"], heap.names["sfi"]), (0, SCRIPT.index(" return f")))
    assert rows(locations.scope_scripts(snap.nodes, snap.edges), "script") == [(heap.names["script"],)] * 2
    assert rows(locations.child_by_name(snap.nodes, snap.edges, "system / Map"), "ord", "child") == [(heap.names["A"], heap.names["map"])]


def test_node_info(snap, heap):
    a = snap.node_info(heap.id("A")).first()
    assert (a["instance_type"], a["location"], a["allocated_at"], a["dominators"]) == ("JS_OBJECT_TYPE", "a.js:4:5", ["alloc (a.js:3:3)", "main (a.js:2:2)"], [heap.id("R")])
    f = snap.node_info(heap.id("f")).first()
    assert f["has_source"] and f["location"] == f"a.js:1:{SCRIPT.index('f(){ return used') + 1}-1:{SCRIPT.index(' return f') + 1}"
    assert (f["bucket"], f["bucket_label"]) == ("", "") and f["detachedness_is_original"]
    r = snap.node_info(heap.id("realm")).first()
    assert (r["bucket"], r["bucket_label"], r["has_source"]) == ("#0", f"[utility] #0 https://x @{heap.id('realm')}", False)
    assert snap.realm(0).first()["id"] == snap.realm(object_id=heap.id("realm")).first()["id"] == heap.id("realm")


def test_reveal_and_search(snap, heap):
    steps = rows(snap.reveal(heap.id("B"), "dominators"), "ord", "rank", "page")
    assert steps == [(heap.names["R"], 0, 0), (heap.names["A"], 0, 0), (heap.names["B"], 0, 0)]
    deep = snap.reveal(heap.id("plain")).collect()
    assert [r["ord"] for r in deep] == [heap.names[n] for n in ("R", "A", "plain")] and deep[-1]["rank"] == 5
    assert snap.reveal(heap.id("plain"), size=2).collect()[-1]["page"] == 4
    assert snap.reveal(heap.id("B"), "summary").first()["name"] == "Foo"
    assert snap.search(" ") is None and rows(snap.search(f"@{heap.id('B')}"), "id") == [(heap.id("B"),)]
    assert {r["name"] for r in snap.search("foo").collect()} == {"Foo", "Foo [a.js:4:5]"}
    with pytest.raises(ValueError, match="object id"):
        snap.search("@x")
    with pytest.raises(KeyError, match="no object"):
        snap.search("@999999")
    sizes = {r["root"]: r["size"] for r in snap.sizes_around(heap.id("ctx")).collect()}
    assert sizes[heap.names["idle"]] == 40 and heap.names["ctx"] in sizes


def test_retainers_report(spark):
    h = Heap().add("x", size=1).add("dead", size=1)
    h.link("R", "x").link("dead", "x", "property", "d")
    for i in range(12):
        h.add(f"h{i}", size=1).link("R", f"h{i}").link(f"h{i}", "x")
    s = Snapshot.from_bytes(spark, h.content())
    first = s.retainers_report(h.id("x")).collect()
    assert len(first) == 10 and first[0]["id"] == h.id("R") and all(r["total"] == 14 for r in first) and first[0]["reached"]
    rest = s.retainers_report(h.id("x"), start=10).collect()
    assert rest[-1]["id"] == h.id("dead") and not rest[-1]["on_plan"] and not rest[-1]["expanded"]
    # a hub's retainers beyond the limit are left out, and it is said
    assert s.retaining_plan(h.id("x"), max_nodes=5).truncated


def test_duplicates_as_groups_and_totals(snap):
    assert rows(snap.duplicate_summary(), "name", "count", "self_size") == [("same", 2, 40)]
    assert tuple(snap.duplicate_totals().first()) == (1, 2, 40, 20)
    assert tuple(snap.timeline_totals().first()) == (3, 350, 250)


def test_fields_of_global_objects_that_others_lack_come_first(spark):
    h = Heap()
    for i in (1, 2):
        h.add(f"g{i}", name="Window [JSGlobalObject] / x").link("R", f"g{i}").add(f"a{i}").link(f"g{i}", f"a{i}", "property", "common")
    h.add("own").link("g1", "own", "property", "own")
    s = Snapshot.from_bytes(spark, h.content())
    assert rows(s.children(h.id("g1")), "edge_name") == [("own",), ("common",)]


def test_saved_and_reopened(spark, snap, heap, tmp_path):
    snap.save(str(tmp_path / "kept"))
    again = Snapshot.reopen(spark, str(tmp_path / "kept"))
    assert sorted(rows(again.summary(), "name", "retained_size")) == sorted(rows(snap.summary(), "name", "retained_size"))
    assert rows(again.dominators_of(heap.id("B")), "id") == rows(snap.dominators_of(heap.id("B")), "id")


def test_extension_titles_and_groups_by_class(spark):
    h = Heap().add("r", name="system / NativeContext / chrome-extension://abc/x.html").link("R", "r")
    for i in (1, 2):
        h.add(f"o{i}", name="Foo", size=i).link("R", f"o{i}")
    h.more = {"location_fields": ["object_index", "script_id", "line", "column"], "locations": ["o1", 7, 1, 2, "o2", 7, 3, 4]}
    s = Snapshot.from_bytes(spark, h.content())
    titles = spark.createDataFrame([("abc", "Tidy"), ("zzz", "Other")], "extension string, title string")
    assert rows(s.realms(titles=titles), "title", "is_extension") == [("Tidy", True)]
    assert {r["id"] for r in s.summary_members("Foo").collect()} == {h.id("o1"), h.id("o2")}
    assert [r["id"] for r in s.summary_members("Foo [script_id=7:L2:3]").collect()] == [h.id("o1")]
