"""Shapes that grow: long ropes, large scripts, many ids."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaploom.functions.formats import utf16_line_col, utf16_line_cols
from heaploom.operators import grouping, locations, naming
from heaploom.sources.heapsnapshot import tables_from_bytes
from tests.graphs import Heap


def rope_text(h, key):
    """Pieces from the left until 1,024 bytes are there."""
    halves = {(a, name): b for a, b, kind, name in h.edges if kind == "internal" and name in ("first", "second")}
    stack, out = [h.names[key]], ""
    while stack and len(out.encode()) < naming.CONS_BYTES:
        v = stack.pop()
        if h.nodes[v][0] != "concatenated string":
            out += h.nodes[v][1]
            continue
        stack += [halves[v, side] for side in ("second", "first") if (v, side) in halves]
    return out


def texts(spark, h):
    t = tables_from_bytes(spark, h.content())
    got = {r["ord"]: r["cons_text"] for r in naming.cons_texts(t["nodes"], t["edges"]).collect()}
    return {k: got[i] for k, i in h.names.items() if i in got}


@pytest.mark.parametrize(("side", "n"), [("first", 5000), ("second", 300)])
def test_a_rope_of_five_thousand_pieces(spark, side, n, monkeypatch):
    h, other = Heap(), "second" if side == "first" else "first"
    for i in range(n):
        h.add(f"p{i}", "string", f"{i % 10}" * 8).add(f"c{i}", "concatenated string", "")
        h.link(f"c{i}", f"p{i}", "internal", other)
        if i:
            h.link(f"c{i}", f"c{i - 1}", "internal", side)
    steps, plain = [], naming.stage
    monkeypatch.setattr(naming, "stage", lambda df, label: steps.append(label) or plain(df, label))
    got = texts(spark, h)
    for i in (0, 1, 2, 17, 127, 128, 129, 299, 4999):
        assert i >= n or got[f"c{i}"] == rope_text(h, f"c{i}")
    assert len(got) == n and sum(s.startswith("cons-step") for s in steps) <= 14


def test_ropes_of_every_shape(spark):
    rng, h = random.Random(8), Heap()
    keys = []
    for i in range(60):
        h.add(f"s{i}", rng.choice(["string", "sliced string"]), rng.choice(["", "ab", "é" * 40, "x" * 700, "y" * 3000]))
        keys.append(f"s{i}")
    for i in range(120):
        h.add(f"c{i}", "concatenated string", "raw")
        for side in ("first", "second"):
            if rng.random() < 0.93:
                h.link(f"c{i}", rng.choice(keys[-8:] + keys[:30]), "internal", side)
        h.link(f"c{i}", rng.choice(keys), "property", "first")
        keys.append(f"c{i}")
    got = texts(spark, h)
    assert got == {k: rope_text(h, k) for k in h.names if k.startswith("c")}
    assert texts(spark, Heap().add("a", "string", "x")) == {}


def test_places_in_a_large_script():
    rng = random.Random(1)
    parts = ["a", "b", "\n", "\r\n", "é", "日", "😀", " "]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        wide = text.encode("utf-16-le")
        for at in range(-1, len(wide) // 2 + 2):
            head = wide[: 2 * at].decode("utf-16-le", "ignore") if at >= 0 else ""
            sound = 0 <= at <= len(wide) // 2 and head.encode("utf-16-le") == wide[: 2 * at]
            assert utf16_line_col(text, at) == ((head.count("\n"), len(head.rpartition("\n")[2].encode("utf-16-le")) // 2) if sound else None)
    script = "function 😀f() { return 1; }\n" * 200_000
    began = time.time()
    sound, line, col = utf16_line_cols(script, np.arange(0, 5_000_000, 500))
    assert len(sound) == 10_000 and time.time() - began < 2 and line[-1] == 4_999_500 // 29


def test_ends_of_ten_thousand_functions(spark):
    h = Heap()
    source = "f(x => x)\n" * 50_000
    h.add("script", "code", "system / Script / a.js").add("source", "string", source).link("script", "source", "internal", "source")
    for i in range(0, 10_000, 4):
        h.add(f"f{i}", "code", "system / SharedFunctionInfo / f").add(f"e{i}", "number", "int").add(f"v{i}", "string", str(i * 40 + 3))
        h.link(f"f{i}", "script", "internal", "script").link(f"f{i}", f"e{i}", "internal", "end_position").link(f"e{i}", f"v{i}", "internal", "value")
    t = tables_from_bytes(spark, h.content())
    began = time.time()
    got = {r["ord"]: (r["line"], r["col"]) for r in locations.function_ends(t["nodes"], t["edges"]).collect()}
    assert got == {h.names[f"f{i}"]: (i * 4, 3) for i in range(0, 10_000, 4)} and time.time() - began < 30


def test_a_timeline_of_a_million_ids(spark):
    nodes = spark.range(1, 1_000_001).select("id", (F.col("id") % 3).alias("self_size"))
    samples = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") * 1000).alias("timestamp_us"), ((F.col("id") + 1) * 1000).alias("last_assigned_id"))
    began = time.time()
    got = grouping.timeline(nodes, samples).collect()
    assert time.time() - began < 20
    assert [(r["count"], r["size"]) for r in got] == [(sum(1 for x in range(1000 * i + 1, 1000 * i + 1001) if x % 3), sum(x % 3 for x in range(1000 * i + 1, 1000 * i + 1001))) for i in range(1000)]
