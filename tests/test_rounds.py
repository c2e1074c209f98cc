"""The analysis in rounds against the kernel, on graphs of every shape."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaploom.operators import grouping, trees
from heaploom.operators.analyse import PARTS, analyse, in_rounds
from heaploom.plans import fixpoint, rounds
from heaploom.plans.staging import bucketed
from heaploom.schema import ANALYSIS
from heaploom.sources.heapsnapshot import tables_from_bytes
from tests.graphs import Heap

COLUMNS = ["ord", *(c.split()[0] for c in ANALYSIS.split(", ")), "class_name", "class_key", "group_name"]


def tables(spark, h):
    t = tables_from_bytes(spark, h.content())
    return t["nodes"], t["edges"]


def same(spark, h, weak=False):
    nodes, edges = tables(spark, h)
    by_task, by_rounds = (sorted(map(tuple, analyse(nodes, edges, weak, parts=p).select(*COLUMNS).collect())) for p in (None, tuple(PARTS)))
    for a, b in zip(by_task, by_rounds, strict=True):
        assert dict(zip(COLUMNS, a)) == dict(zip(COLUMNS, b))


def tangle(seed, n=60, m=130):
    """Cycles, unreachable parts, weak maps, natives, contexts, realms and plain objects."""
    rng = random.Random(seed)
    h = Heap(detachedness=True)
    for s in ("(System)", "(Document DOM trees)"):
        h.add(s, "synthetic", s).link("root", s)
    for i in range(n):
        kind = rng.choice(["object", "object", "native", "code", "array"])
        name = rng.choice(["Object", "Object", "A", "system / Context", "system / NativeContext / https://x", "(map descriptors)", "Window"])
        h.add(f"n{i}", kind, name, rng.randint(0, 9), rng.choice([0, 0, 0, 1, 2, 3]) if kind == "native" else 0)
    names = list(h.names)[2:]
    for _ in range(m):
        kind = rng.choice(["property", "property", "property", "weak", "shortcut", "element", "internal"])
        label = rng.randint(0, 9) if kind == "element" else rng.choice(["map", "native_context", "sloppy_function_map", "a", "b", "c", "Symbol(x)", "__proto__", "global_object", "length of a name that is more than sixty bytes, in the end, it is"])
        h.link(rng.choice(["R", "root", *names, *names[:6]]), rng.choice(names[2:]), kind, label)
    for i in range(n // 6):
        k, v, t = rng.sample(names[2:], 3)
        text = f" / part of key (K @{h.id(k)}) -> value (V @{h.id(v)}) pair in WeakMap (table @{h.id(t)})"
        h.link(k, v, "internal", f"{2 * i}{text}").link(t, v, "internal", f"{2 * i + 1}{text}")
    return h


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_kernel(spark, seed):
    same(spark, tangle(seed), weak=seed % 2 == 1)


def test_an_irreducible_graph(spark):
    # every node of the loop is entered from outside, and a wave of moves runs through it
    h = Heap()
    for k in "abcdefgh":
        h.add(k, size=1)
    h.chain("R", "a", "b", "c", "d", "e", "b").chain("a", "d").chain("c", "f", "g", "f").chain("e", "g").chain("h", "h")
    same(spark, h)


def brute_idoms(n, edges, r):
    def reach(without):
        seen, todo = {r}, [r]
        while todo:
            v = todo.pop()
            new = {b for a, b in edges if a == v} - seen - {without}
            seen |= new
            todo += new
        return seen

    alive = reach(None)
    doms = {v: {u for u in alive if u in (r, v) or v not in reach(u)} for v in alive}
    return {v: max(doms[v] - {v}, key=lambda u: len(doms[u]), default=r) for v in alive}


def test_dominators_of_eight_regions(spark):
    """Eight tangles that one node each enters, linked in a ring at random: the least task does not see all nodes."""
    rng = random.Random(11)
    h = Heap()
    for g in range(8):
        for i in range(12):
            h.add(f"{g}.{i}", size=rng.randint(1, 5))
        for i in range(1, 12):
            h.link(f"{g}.{rng.randrange(i)}", f"{g}.{i}", "property", "t")
            h.link(f"{g}.{rng.randrange(12)}", f"{g}.{rng.randrange(1, 12)}", "property", "x")
    h.link("R", "0.0")
    for g in range(8):
        for step in (1, rng.randint(1, 3)):
            h.link(f"{g}.{rng.randrange(12)}", f"{(g + step) % 8}.0", "property", "y")
    nodes, edges = tables(spark, h)
    got = {r["ord"]: r for r in in_rounds(nodes, edges, parts=["dominators", "retained", "preorder"], label="regions").collect()}
    links = {(h.names[a], h.names[b]) for a, b in ((list(h.names)[s], list(h.names)[d]) for s, d, _, _ in h.edges) if a != "root" and a != b}
    want = brute_idoms(len(h.names), links, 1)
    assert {v: got[v]["idom"] for v in want} == want
    sizes = {i: s for i, (_, _, _, s, _, _) in enumerate(h.nodes)}
    below = lambda v: sizes[v] + sum(below(c) for c in want if want[c] == v and c != v)
    assert all(got[v]["retained_size"] == below(v) for v in want)
    tins = sorted(r["tin"] for r in got.values())
    assert tins == list(range(len(h.names))) and all(got[r["idom"]]["tin"] <= r["tin"] <= r["tout"] <= got[r["idom"]]["tout"] for r in got.values())


def test_rounds_do_not_shuffle_edges(spark):
    rows = spark.range(5000)
    e = bucketed(rows.select((F.col("id") % 700).alias("src"), F.col("id").alias("dst")), "src", "plan-test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixpoint.met(rows.select(F.col("id").alias("ord")), e)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_roots_as_bits(spark):
    """More roots than a word has bits, against plain searches."""
    rng = random.Random(6)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(420)]
    roots = list(range(0, 300, 2))
    df = spark.createDataFrame(e, "src bigint, dst bigint")
    pairs = fixpoint.reachable_from_each(df, spark.createDataFrame([(r,) for r in roots], "ord bigint"))
    want = set()
    for r in roots:
        seen, todo = {r}, [r]
        while todo:
            new = {b for a, b in e if a == todo[-1]} - seen
            todo.pop()
            seen |= new
            todo += new
        want |= {(r, v) for v in seen}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


def test_paths_double(spark):
    parents = [(0, 0)] + [(i, i - 1) for i in range(1, 40)] + [(i, i % 7) for i in range(40, 60)]
    got = {r["ord"]: r["path"] for r in rounds.paths_of(spark.createDataFrame(parents, "ord bigint, parent bigint"), 0, "doubling").collect()}
    assert got == {i: list(range(i + 1)) if i < 40 else [*range(i % 7 + 1), i] for i in range(60)}
    assert np.sum([len(p) for p in got.values()]) > 800


def test_what_leads_nowhere_takes_no_part_in_the_rounds(spark, monkeypatch):
    """Hubs that hold leaves, alone or two by two: only hubs get paths, and leaves hang where the kernel hangs them."""
    h = Heap()
    h.add("hub", size=1).link("R", "hub")
    for i in range(10):
        h.add(f"h{i}", size=2).link("hub", f"h{i}")
    for i in range(200):
        h.add(f"l{i}", size=3).link(f"h{i % 10}", f"l{i}")
        if i % 3:
            h.link(f"h{i % 7}", f"l{i}").link("hub", f"l{i}") if i % 5 == 0 else h.link(f"h{i % 7}", f"l{i}")
    nodes, edges = tables(spark, h)
    rows, plain = {}, rounds.stage
    monkeypatch.setattr(rounds, "stage", lambda df, label, *by: rows.setdefault(label, (t := plain(df, label, *by), t.count()))[0])
    got = in_rounds(nodes, edges, parts=["dominators", "retained"], label="leaves")
    got = {r["ord"]: (r["idom"], r["dom_depth"], r["retained_size"]) for r in got.collect()}
    assert max(n for label, (_, n) in rows.items() if "path" in label) == 12
    want = {r["ord"]: (r["idom"], r["dom_depth"], r["retained_size"]) for r in analyse(nodes, edges).collect()}
    assert got == want


def test_nesting(spark):
    """Intervals that only nest give the same summary and the same chains as the preorder does."""
    nodes, edges = tables(spark, tangle(5))
    whole, nested = analyse(nodes, edges), analyse(nodes, edges, parts=["dominators", "retained", "distance", "interfaces", "nesting"])
    by_class = lambda x: sorted(map(tuple, grouping.summary(x).collect()), key=repr)
    assert by_class(whole) == by_class(nested)
    deep = [r["ord"] for r in whole.orderBy(F.desc("dom_depth"), "ord").limit(2).collect()]
    leaf = whole.where("tin = tout").orderBy("ord").first()["ord"]
    for v in [*deep, leaf]:
        a, b = ([r["ord"] for r in trees.dominator_chain(t, v).collect()] for t in (whole, nested))
        assert a == b and a[0] == v
