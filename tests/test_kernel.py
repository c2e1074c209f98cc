"""The analysis of single snapshots against hand-made graphs and brute force."""

import random

import numpy as np
import pytest

from heaploom.schema import NO_DISTANCE, UNREACHABLE_BASE
from tests.graphs import Heap

U = UNREACHABLE_BASE


def sizes(h):
    g = h.graph()
    idom, depth, tin, tout, retained = g.dominators()
    return h.by_name(retained), h.by_name([list(h.names)[i] for i in idom])


def far(h, weak=False):
    g = h.graph()
    return h.by_name(g.with_unreachable(g.distances(), weak))


def test_diamond():
    h = Heap().add("Top", size=100).add("Left", size=60).add("Right", size=40).add("Bottom", size=30)
    h.chain("R", "Top", "Left", "Bottom").chain("Top", "Right", "Bottom")
    retained, idom = sizes(h)
    assert [retained[k] for k in ("Top", "Left", "Right", "Bottom")] == [230, 60, 40, 30]
    assert idom["Bottom"] == "Top"


def test_ephemeron_belongs_to_the_table_and_opens_with_both():
    for flip in (False, True):
        h = Heap().add("Key", size=50).add("Table", size=30).add("Val", size=500)
        h.add("a").add("b").add("c").add("d")
        far_one, near_one = ("Key", "Table") if flip else ("Table", "Key")
        h.chain("R", near_one).chain("R", "a", "b", "c", "d", far_one)
        name = f" / part of key (Key @{h.id('Key')}) -> value (Val @{h.id('Val')}) pair in WeakMap (table @{h.id('Table')})"
        h.link("Key", "Val", "internal", "1" + name).link("Table", "Val", "internal", "2" + name)
        assert far(h)["Val"] == 6
        retained, _ = sizes(h)
        assert (retained["Table"], retained["Key"]) == (530, 50)


def test_weak_edges_hold_nothing_but_may_seed():
    h = Heap().add("Reachable", size=100).add("Unreachable", size=300).add("Child", size=150)
    h.chain("R", "Reachable").link("Reachable", "Unreachable", "weak").chain("Unreachable", "Child")
    d = far(h)
    assert (d["Reachable"], d["Unreachable"], d["Child"]) == (1, U, U + 1)
    d = far(h, weak=True)
    assert (d["Unreachable"], d["Child"]) == (2, 3)


def test_unreachable_cycles_take_their_lowest_node():
    h = Heap().add("a").add("b").add("c").chain("a", "b", "c", "a")
    h.add("self").link("self", "self")
    d = far(h)
    assert (d["a"], d["b"], d["c"], d["self"]) == (U, U + 1, U + 2, U)
    assert NO_DISTANCE not in d.values()


def test_structural_edges():
    h = Heap().add("map", "array", "(map descriptors)")
    h.link("R", "map")
    for i in (0, 1, 2, 3, 4, 7):
        h.add(f"e{i}").link("map", f"e{i}", "element", i)
    h.add("ctx", "object", "system / NativeContext").link("R", "ctx").add("sloppy").link("ctx", "sloppy", "internal", "sloppy_function_map")
    d = far(h)
    assert [d[f"e{i}"] < U for i in (0, 1, 2, 3, 4, 7)] == [True, True, True, True, False, False]
    assert d["sloppy"] >= U


def test_root_kinds_and_missing_roots():
    h = Heap().add("dom", "synthetic", "(Document DOM trees)").add("sys", "synthetic", "(Other)").add("win", "object", "Window")
    for k in ("dom", "sys", "win"):
        h.link("root", k)
    kinds = h.by_name(h.graph().root_kind)
    assert [kinds[k] for k in ("root", "R", "dom", "sys", "win")] == ["SyntheticRoot", "SystemRoot", "UserRoot", "SystemRoot", "UserRoot"]
    h.nodes[1] = ("synthetic", "(other)", 3, 0, 0, 0)
    with pytest.raises(ValueError, match="GC roots"):
        h.graph()


def test_detachedness_spreads_through_natives_and_to_what_only_they_hold():
    h = Heap(detachedness=True).add("live", "native", size=1, det=1).add("kid", "native", size=1).add("gone", "native", size=1, det=2)
    h.add("only", size=1).add("both", size=1).add("lost", size=1)
    h.chain("R", "live", "kid").chain("R", "gone", "only").chain("gone", "both").chain("live", "both")
    got = h.by_name(h.graph().detachedness())
    assert [got[k] for k in ("live", "kid", "gone", "only", "both", "lost")] == [1, 1, 2, 2, 0, 0]


def test_realm_buckets():
    h = Heap()
    for i in (1, 2):
        h.add(f"c{i}", "object", f"system / NativeContext / https://{i}").add(f"m{i}", "hidden").add(f"mm{i}", "hidden")
        h.link("R", f"c{i}").link(f"m{i}", f"mm{i}", "internal", "map").link(f"mm{i}", f"c{i}", "internal", "native_context")
        h.add(f"o{i}").link(f"o{i}", f"m{i}", "internal", "map")
    h.add("shared").link("o1", "shared").link("o2", "shared", "weak").add("mine").link("o1", "mine", "weak").add("cut").link("o1", "cut", "shortcut").add("free").link("R", "free")
    g = h.graph()
    got = h.by_name(g.buckets(g.realms()))
    assert [got[k] for k in ("o1", "o2", "shared", "mine", "cut", "free")] == [0, 1, -2, 0, -1, -1]


def test_contexts_retain():
    h = Heap().add("ctx", "object", "system / Context").add("held").add("both").add("lost")
    h.chain("R", "ctx", "held").chain("ctx", "both").chain("R", "both")
    g = h.graph()
    got = h.by_name(g.retention(g.distances()))
    assert [got[k] for k in ("ctx", "held", "both", "lost")] == ["Retained", "Retained", "NotRetained", "Unreachable"]


def test_interfaces():
    h = Heap()
    for i, props in enumerate(["ab", "ab", "abc", "x"]):
        h.add(f"o{i}", "object", "Object", 8).link("R", f"o{i}")
        for p in props:
            h.link(f"o{i}", "R", "property", p)
    got = h.by_name(h.graph().interfaces())
    assert [got[f"o{i}"] for i in range(4)] == ["{a, b}", "{a, b}", "{a, b}", None]


def brute_idom(g):
    """The definition: u dominates v if nothing else leads to v without u."""
    keep = g.essential()
    edges = {(int(a), int(b)) for a, b in zip(g.src[keep], g.dst[keep])}
    r = g.gc_roots

    def reach(edges, without=None):
        seen, todo = {r}, [r]
        while todo:
            v = todo.pop()
            for a, b in edges:
                if a == v and b not in seen and b != without:
                    seen.add(b)
                    todo.append(b)
        return seen

    alive, entered = reach(edges), {b for _, b in edges}
    edges |= {(r, o) for o in range(g.n) if o not in alive and o not in entered and o != r}
    alive = reach(edges)
    doms = {v: {r, v} for v in range(g.n)}
    for u in range(g.n):
        if u != r:
            for v in alive - reach(edges, u):
                doms[v].add(u)
    # the nearest strict dominator has the most dominators of its own
    return [r if v == r or v not in alive else max(doms[v] - {v}, key=lambda u: len(doms[u])) for v in range(g.n)]


def test_dominators_against_removal():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 9)
        h = Heap()
        for i in range(n):
            h.add(f"n{i}", size=rng.randint(1, 9))
        names = ["root", "R"] + [f"n{i}" for i in range(n)]
        for _ in range(rng.randint(0, 2 * n)):
            h.link(rng.choice(names), rng.choice(names[2:]), rng.choice(["property", "property", "weak", "shortcut"]), "e")
        g = h.graph()
        idom, depth, tin, tout, retained = g.dominators()
        assert idom.tolist() == brute_idom(g)
        assert retained[g.gc_roots] == g.size.sum()
        for v in range(g.n):
            p = idom[v]
            assert tin[p] <= tin[v] and tout[v] <= tout[p]
            inside = (tin >= tin[v]) & (tout <= tout[v])
            assert retained[v] == g.size[inside].sum()
        assert len(np.unique(tin)) == g.n
