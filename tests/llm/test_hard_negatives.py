"""Cover trees and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaploom.llm import hard_negatives as hn


def brute(rows, is_anchor, positives=5, negatives=5, low=80, scale=256):
    sound, seen = [], set()
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(scale * x) for x in v) + (0,) * (dim - len(v))
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            sound.append((i, q, label))
    out = []
    for i, q, label in sound:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j, other) for j, p, other in sound)
        for minus, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            inside = [s for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= 100 * -minus]
            out += [(i, j, r, s[1], -minus, -s[0]) for r, s in enumerate(inside[:negatives], 1)]
    return sorted(out)


def vectors(n, dim=8, seed=2):
    rng = random.Random(seed)
    hot = [rng.gauss(0.2, 0.4) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = hot if rng.random() < 0.3 else [rng.gauss(0.3, 0.4) for _ in range(dim)]
        rows.append((i, v, rng.randrange(3)))
    return rows + rows[:5] + [(n, None, 1), (n + 1, [float("nan")] * dim, 1), (n + 2, [float("inf")] * dim, 0), (n + 3, [None] * dim, 2), (n + 4, [0.5] * dim, None), (None, [0.5] * dim, 1), (-10, [0.1] * dim, 2), (n + 5, [0.4] * (dim - 3), 1), (n + 6, [], 1), (n + 7, [0.0] * dim, 0), (20, [1.0] * dim, 0)]


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, **k):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hn.mine(df, F.col("vec_id") % 10 == 0, **k).collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = vectors(400)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({"rank": F.lit(1), "_id": F.lit("x"), "anchor_id": F.lit(2)})
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute(single, lambda i: i % 10 == 0)
    assert want and mined(df) == want
    # many small trees, deep ones, and anchors in several blocks
    for name, value in (("TREE_ROWS", 40), ("LEAF_ROWS", 4), ("FAN", 3), ("BLOCK_ANCHORS", 7)):
        monkeypatch.setattr(hn, name, value)
    assert mined(df.repartition(3)) == want
    assert mined(df, positives=2, negatives=3, low_percent=50, scale=16) == brute(single, lambda i: i % 10 == 0, 2, 3, 50, 16)
    assert mined(df.limit(0)) == [] and mined(df.where("embedding is null")) == [] and mined(df.where("vec_id = 20")) == []


def test_large_components_are_exact(spark):
    rows = [(i, [1e7 + i, 3e6 - i * 7.7, 1.0 * i], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert mined(df) == brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("dim", [1, 3, 20])
def test_trees_cover_separate_and_skip(dim):
    rng = np.random.default_rng(dim)
    x = np.floor(rng.normal(0, 40, (3000, dim)))
    x[:700] = x[0]
    most = float(np.sqrt((x * x).sum(axis=1).max()))
    tree, space = hn.CoverTree(x, most), hn.augmented(x, most)
    assert sorted(tree.order) == list(range(3000))
    for node in range(len(tree.start)):
        own = tree.order[tree.start[node] : tree.stop[node]]
        assert np.linalg.norm(space[own] - space[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-6
        kids = range(tree.child[node], tree.child[node] + tree.children[node])
        if kids:
            c = space[tree.centre[list(kids)]]
            apart = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(c), 1)]
            assert tree.centre[kids[0]] == tree.centre[node] and apart.min() >= max(tree.radius[k] for k in kids) - 1e-6
            assert tree.start[kids[0]] == tree.start[node] and tree.stop[kids[-1]] == tree.stop[node]
        else:
            assert len(own) <= hn.LEAF_ROWS or tree.radius[node] == 0


def test_descent_scores_few_leaves():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (40, 6))
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 5, (4000, 6)))
    made = hn.CoverTree(x, float(np.sqrt((x * x).sum(axis=1).max())))
    o = made.order
    row = {"rows": 4000, "dim": 6, "ids": o.astype(np.int64).tobytes(), "labels": np.zeros(4000, np.int64).tobytes(), "vectors": x[o].tobytes(), "centres": x[made.centre].tobytes(), "radius": made.radius.tobytes()} | {k: getattr(made, k).tobytes() for k in ("start", "stop", "child", "children")}
    tree, scored, fits = hn._Tree(row), [], lambda asked, rows: scored.append(len(asked) * (rows.stop - rows.start)) or np.ones((len(asked), rows.stop - rows.start), bool)
    q = x[::400]
    plain = q @ x.T
    top = plain.max(axis=1)
    best = hn.Best(np.column_stack([np.full(len(q), -np.inf), np.ceil(top / 4)]), np.column_stack([np.full(len(q), np.inf), np.floor(top / 3)]), 5)
    hn.descend(tree, q, fits, best)
    for i, scores in enumerate(plain):
        for w in range(2):
            want = sorted((-s, j) for j, s in enumerate(scores) if best.lo[i, w] <= s <= best.hi[i, w])[:5]
            assert [(-s, j) for s, j in zip(best.scores[i, w], best.ids[i, w], strict=True) if s > -np.inf] == want
    assert sum(scored) < 0.4 * 4000 * 10
