"""Rounds of joins against the kernel and plain loops."""

import random

from pyspark.sql import functions as F

from heaploom.operators.scopes import smallest_enclosing
from heaploom.plans import fixpoint


def graph(spark, n=60, m=110, seed=1):
    rng = random.Random(seed)
    e = [(rng.randrange(n), rng.randrange(n), rng.choice(["property", "weak", "shortcut"])) for _ in range(m)]
    return e, spark.createDataFrame(e, "src bigint, dst bigint, type string")


def test_bfs_and_batches(spark):
    e, df = graph(spark)
    dist, frontier = {0: 0}, [0]
    while frontier:
        frontier = sorted({b for a, b, k in e if a in frontier and k != "weak" and b not in dist})
        dist |= {b: max(dist.values()) + 1 for b in frontier}
    roots = spark.createDataFrame([(0,), (1,)], "ord bigint")
    got = fixpoint.bfs(df, roots.where("ord = 0"), F.col("type") != "weak")
    assert dict(map(tuple, got.collect())) == dist
    both = fixpoint.reachable_from_each(df, roots, F.col("type") != "weak")
    assert {r["ord"] for r in both.where("root = 0").collect()} == set(dist)


def test_attribution_and_chains(spark):
    e, df = graph(spark, seed=4)
    owners = {0: 5, 1: 7}
    low, high = dict(owners), dict(owners)
    for _ in range(100):
        for a, b, k in e:
            if k != "shortcut" and a != b and b not in owners and a in low:
                low[b], high[b] = min(low.get(b, 99), low[a]), max(high.get(b, -1), high[a])
    got = fixpoint.attribute(df, spark.createDataFrame(list(owners.items()), "ord bigint, owner bigint"))
    assert {r["ord"]: (r["low"], r["high"]) for r in got.collect()} == {k: (low[k], high[k]) for k in low}
    links = [(i, i - 1 if i % 10 else None) for i in range(40)] + [(100, 101), (101, 100)]
    ends = fixpoint.chase(spark.createDataFrame(links, "ord bigint, next bigint"))
    assert dict(map(tuple, ends.collect())) == {i: i - i % 10 for i in range(40)}


def test_smallest_scope(spark):
    rng = random.Random(2)
    scopes = [(i, a, a + rng.choice([0, 1, 2, 7, 64, 500])) for i, a in enumerate(rng.randrange(600) for _ in range(80))]
    points = list(range(0, 700, 3))
    got = smallest_enclosing(spark.createDataFrame([(p,) for p in points], "pos bigint"), spark.createDataFrame(scopes, "scope bigint, start bigint, end bigint"))
    want = {}
    for p in points:
        inside = [(b - a, i) for i, a, b in scopes if a <= p < b]
        if inside:
            want[p] = min(inside)[1]
    assert dict(map(tuple, got.select("pos", "scope").collect())) == want
