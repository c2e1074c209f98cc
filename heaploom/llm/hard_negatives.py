"""Hard negatives by inner product, from cover trees over norm-augmented vectors."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaploom.llm.common import appended, bounded_batches
from heaploom.plans.staging import free, stage

#: Rows that are indexed in one tree, about; rows of a leaf; children of a node.
TREE_ROWS, LEAF_ROWS, FAN = 2048, 128, 16
#: Rows on which cells are fitted at most, and cells; their bytes at most.
SAMPLE_ROWS, CELLS, CELL_BYTES = 4096, 256, 8 << 20
#: Anchors whose vectors are told to all tasks at once, and bytes of these.
BLOCK_ANCHORS, BLOCK_BYTES = 8192, 16 << 20
#: Sums of products below this are exact in 64-bit floats.
EXACT = float(1 << 53)


def quantised(rows: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(_id, _label, _vec, _anchor) of the rows that take part; components become floor(scale * x)."""
    sound = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = rows.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_label"), F.col(vector).cast("array<double>").alias("_vec"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    kept = named.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vec").isNotNull() & sound)
    return kept.withColumn("_vec", F.transform("_vec", lambda x: F.floor(x * scale).cast("double")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with a coordinate more that gives all of them the norm ``most``: then near is the same as of large inner product."""
    return np.column_stack([x, np.sqrt(np.maximum(0, most * most - np.einsum("ij,ij->i", x, x)))])


def farthest_first(x: np.ndarray, most: int, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres, each the row farthest from those before it; the nearest centre of each row, and its distance."""
    centres, owner = [first], np.zeros(len(x), np.int64)
    far = np.linalg.norm(x - x[first], axis=1)
    while len(centres) < most:
        new = int(far.argmax())
        if far[new] == 0:
            break
        d = np.linalg.norm(x - x[new], axis=1)
        nearer = d < far
        owner[nearer] = len(centres)
        far = np.where(nearer, d, far)
        centres.append(new)
    return centres, owner, far


class CoverTree:
    """Rows in an order in which each node has a run of them.

    A node's centre is one of its rows and its radius covers all of them. Its children are
    centred at its own centre and at rows each farther from all others than the level's
    covering radius, and take the rows that are nearest to them.
    """

    def __init__(self, x: np.ndarray, most: float) -> None:
        space = augmented(x, most)
        self.order = np.arange(len(x))
        start, stop, centre, radius, child, children = [0], [len(x)], [0], [0.0], [0], [0]
        radius[0] = float(np.linalg.norm(space - space[0], axis=1).max()) if len(x) else 0.0
        at = 0
        while at < len(start):
            a, b = start[at], stop[at]
            if b - a > LEAF_ROWS and radius[at] > 0:
                rows = self.order[a:b].copy()
                own = int(np.flatnonzero(rows == centre[at])[0])
                centres, owner, far = farthest_first(space[rows], FAN, own)
                by = np.argsort(owner, kind="stable")
                self.order[a:b] = rows[by]
                sizes = np.bincount(owner, minlength=len(centres))
                widest = np.zeros(len(centres))
                np.maximum.at(widest, owner, far)
                child[at], children[at] = len(start), len(centres)
                for c, n, r in zip(centres, sizes.tolist(), widest.tolist(), strict=True):
                    start.append(a)
                    a += n
                    stop.append(a)
                    centre.append(int(rows[c]))
                    radius.append(r)
                    child.append(0)
                    children.append(0)
            at += 1
        self.start, self.stop, self.child, self.children = (np.array(v, np.int64) for v in (start, stop, child, children))
        self.centre, self.radius = np.array(centre, np.int64), np.array(radius)


_TREE = ["ids", "labels", "vectors", "centres", "radius", "start", "stop", "child", "children"]
FOREST = "rows int, dim int, " + ", ".join(f"{c} binary" for c in _TREE)


def _plant(dim: int, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trees of rows that come sorted by (cell, chunk)."""

    def tree(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        ids, labels, x = t["_id"].to_numpy(), t["_label"].to_numpy(), matrix(t["_vec"], dim)
        # rows alike in everything are one
        order = np.lexsort((*x.T, labels, ids))
        same = np.zeros(len(ids), bool)
        same[1:] = (ids[order][1:] == ids[order][:-1]) & (labels[order][1:] == labels[order][:-1]) & (x[order][1:] == x[order][:-1]).all(axis=1)
        kept = order[~same]
        ids, labels, x = ids[kept], labels[kept], x[kept]
        made = CoverTree(x, most)
        values = [ids[made.order], labels[made.order], x[made.order], x[made.centre], made.radius, made.start, made.stop, made.child, made.children]
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values)], ["rows", "dim", *_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * (1 << 32) + batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[a] != now and waiting:
                    yield tree(waiting)
                    waiting = []
                now = keys[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield tree(waiting)

    return run


def _cells(rows: DataFrame, dim: int, most: float, n: int) -> DataFrame:
    """``rows`` with _cell, the nearest of centres fitted on a bounded sample, and _chunk, so that no cell fills a tree.

    Which cell a row is in decides how much a search can skip, never what it finds.
    """
    want = min(CELLS, max(1, CELL_BYTES // (8 * (dim + 1))), -(-n // TREE_ROWS))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(min(SAMPLE_ROWS, max(16 * want, CELL_BYTES // (8 * (dim + 1))))).select("_vec").toArrow()
    space = augmented(matrix(sample["_vec"], dim), most)
    centres = space[farthest_first(space, want)[0]] if len(space) else np.zeros((1, dim + 1))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = np.einsum("ij,ij->i", centres, centres) / 2
        for batch in batches:
            cell = (augmented(matrix(batch.column(2), dim), most) @ centres.T - half).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], ["_cell", "_id", "_label", "_vec"])

    found = stage(rows.mapInArrow(nearest, "_cell int, _id bigint, _label bigint, _vec array<double>"), "negatives-cells")
    sizes = {r["_cell"]: r["count"] for r in found.groupBy("_cell").count().collect()}  # CELLS rows at most
    chunks = F.element_at(F.array(*[F.lit(-(-sizes.get(i, 0) // TREE_ROWS) or 1) for i in range(len(centres))]), F.col("_cell") + 1)
    return found.select("_cell", F.pmod(F.xxhash64("_id"), chunks).cast("int").alias("_chunk"), "_id", "_label", "_vec")


def forest(rows: DataFrame, dim: int, most: float, n: int) -> DataFrame:
    """All rows in written cover trees of about TREE_ROWS rows, one tree a row."""
    placed = _cells(rows, dim, most, n)
    dealt = placed.repartition(max(1, min(n // TREE_ROWS + 1, 100_000)), "_cell", "_chunk").sortWithinPartitions("_cell", "_chunk")
    return stage(dealt.mapInArrow(_plant(dim, most), FOREST), "negatives-forest")


class _Tree:
    def __init__(self, row: dict) -> None:
        n, dim = row["rows"], row["dim"]
        read = lambda c, kind=np.int64: np.frombuffer(row[c], kind)
        self.ids, self.labels, self.x = read("ids"), read("labels"), read("vectors", np.float64).reshape(n, dim)
        self.centres, self.radius = read("centres", np.float64).reshape(-1, dim), read("radius", np.float64)
        self.start, self.stop, self.child, self.children = (read(c).tolist() for c in ("start", "stop", "child", "children"))


class Best:
    """The first ``k`` rows found for each anchor and window: scores downwards, ties by smaller id."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int) -> None:
        self.lo, self.hi, self.k = lo, hi, k
        self.scores = np.full((*lo.shape, k), -np.inf, lo.dtype)
        self.ids = np.zeros((*lo.shape, k), np.int64)

    def need(self) -> np.ndarray:
        """What a score must reach to count; as high as the last one, it may have the smaller id."""
        return np.maximum(self.lo, self.scores[:, :, -1])

    def put(self, anchor: int, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[anchor, window], scores), np.append(self.ids[anchor, window], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[anchor, window], self.ids[anchor, window] = scores[order], ids[order]


def descend(tree: _Tree, q: np.ndarray, fits: Callable[[np.ndarray, slice], np.ndarray], best: Best) -> None:
    """Put into ``best`` the rows of ``tree`` that fit an anchor (rows of ``q``) and lie in its windows.

    A node's bounds are its centre's inner product plus and minus its radius times the
    anchor's length. Nodes come by the highest bound that any anchor has; for each, the
    anchors drop out for which it lies outside all windows or below what they have already,
    and the rows of a leaf are scored exactly for those that are left.
    """
    lengths = np.linalg.norm(q.astype(np.float64), axis=1)

    def bounds(a: int, b: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, reach = tree.centres[a:b] @ q[asked].astype(np.float64).T, np.outer(tree.radius[a:b], lengths[asked])
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle + reach + slack, middle - reach - slack

    def open_(up: np.ndarray, down: np.ndarray, asked: np.ndarray) -> np.ndarray:
        return ((up[:, None] >= best.need()[asked]) & (down[:, None] <= best.hi[asked])).any(axis=1)

    every = np.arange(len(q))
    up, down = bounds(0, 1, every)
    heap = [(-float(up.max()), 0, every, up[0], down[0])]
    while heap:
        _, node, asked, up, down = heapq.heappop(heap)
        left = open_(up, down, asked)
        asked = asked[left]
        if not len(asked):
            continue
        if tree.children[node]:
            first = tree.child[node]
            ups, downs = bounds(first, first + tree.children[node], asked)
            for i, (u, d) in enumerate(zip(ups, downs, strict=True)):
                heapq.heappush(heap, (-float(u.max()), first + i, asked, u, d))
            continue
        rows = slice(tree.start[node], tree.stop[node])
        found = q[asked] @ tree.x[rows].T.astype(q.dtype)
        good, need = fits(asked, rows), best.need()[asked]
        for w in range(best.lo.shape[1]):
            inside = good & (found >= need[:, w, None]) & (found <= best.hi[asked, w, None])
            for i in np.flatnonzero(inside.any(axis=1)).tolist():
                best.put(int(asked[i]), w, found[i, inside[i]], tree.ids[rows][inside[i]])


HITS = "anchor int, window int, id bigint, score bigint"


def _search(queries: object, same: bool, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task descends all of its trees with every anchor, and hands on its first ``k`` per anchor and window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x, widest, lo, hi = queries.value
        # sums of products that 64-bit floats may round are kept in floats of 64 digits, exact for scores that fit a long
        kind = np.float64 if widest * np.abs(x).max(initial=0) * x.shape[1] < EXACT else np.longdouble
        q, best = x.astype(kind), Best(lo.astype(kind), hi.astype(kind), k)
        for batch in batches:
            for row in batch.to_pylist():
                tree = _Tree(row)

                def fits(asked: np.ndarray, rows: slice, tree: _Tree = tree) -> np.ndarray:
                    alike = tree.labels[rows] == labels[asked, None]
                    return alike & (tree.ids[rows] != ids[asked, None]) if same else ~alike

                if len(tree.ids) and len(q):
                    descend(tree, q, fits, best)
        at = np.nonzero(best.scores > -np.inf)
        columns = [at[0].astype(np.int32), at[1].astype(np.int32), best.ids[at], best.scores[at].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "window", "id", "score"])

    return run


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _told(trees: DataFrame, queries: tuple, same: bool, k: int) -> DataFrame:
    told = trees.sparkSession.sparkContext.broadcast(queries)
    return _first(trees.mapInArrow(_search(told, same, k), HITS), k)


def _block(trees: DataFrame, anchors: DataFrame, dim: int, widest: float, positives: int, negatives: int, low_percent: int) -> DataFrame:
    """What is found for one block of anchors, whose vectors, and then whose windows, are told to all tasks."""
    spark = trees.sparkSession
    block = anchors.select("_id", "_label", "_vec").toArrow()
    ids, labels, x = block["_id"].to_numpy(), block["_label"].to_numpy(), matrix(block["_vec"], dim)
    every = np.full((len(ids), 1), np.inf)
    like = _told(trees, (ids, labels, x, widest, -every, every), True, positives).select("anchor", "id", "score").toArrow()
    lo, hi, filled = np.full((len(ids), positives), np.inf, np.longdouble), np.full((len(ids), positives), -np.inf, np.longdouble), [0] * len(ids)
    named = []
    for anchor, positive, score in zip(*(like[c].to_pylist() for c in ("anchor", "id", "score")), strict=True):
        w = filled[anchor]
        filled[anchor] += 1
        lo[anchor, w], hi[anchor, w] = -(-low_percent * score // 100), score
        named.append((anchor, w, int(ids[anchor]), positive, score))
    names = spark.createDataFrame(named, "anchor int, window int, anchor_id bigint, positive_id bigint, positive_score bigint")
    hits = _told(trees, (ids, labels, x, widest, lo, hi), False, negatives)
    return hits.join(F.broadcast(names), ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says which rows of ``rows`` are anchors. A score is the inner product of
    components floor(scale * x) as an exact integer; higher comes first, then the smaller key.
    An anchor's positives are its first other rows of its label, its negatives for each of them
    the first rows of other labels that score from ``low_percent`` of the positive's score up
    to that score. Rows with a null key, label or vector, or a component that is null or not
    finite, take no part; shorter vectors are filled up with zeros; rows alike in key, label and
    quantised vector are one row, and rows with the anchor's key are not its positives. Empty
    tables and anchors without positives give no rows. Other columns are ignored, whatever
    their names. Results are exact.

    Every row is in one tree. Anchors go to the trees in blocks of BLOCK_ANCHORS, each told to
    all tasks; within a task what earlier trees gave an anchor bounds the later ones. A task
    hands on at most the first few of an anchor.
    """
    bounded_batches(rows)
    chosen = stage(quantised(rows, anchors, key, vector, label, scale), "negatives-rows")
    n, dim, square, widest, asked = chosen.agg(F.count(F.lit(1)), F.max(F.size("_vec")), F.max(F.aggregate("_vec", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.array_max(F.transform("_vec", F.abs))), F.count_if("_anchor")).first()
    dim, widest = max(1, dim or 0), widest or 0.0
    trees = forest(chosen.drop("_anchor"), dim, float(square or 0) ** 0.5, n)
    size = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * dim)))
    # twice as many blocks as would do, as they are dealt by a hash
    blocks = -(-2 * asked // size) if asked > size else min(1, asked)
    dealt = chosen.where("_anchor").withColumn("_block", F.pmod(F.xxhash64("_id", "_label", "_vec"), F.lit(max(1, blocks)))).drop("_anchor").distinct()
    dealt = stage(dealt.repartitionByRange("_block"), "negatives-anchors")
    found = (_block(trees, dealt.where(F.col("_block") == b), dim, widest, positives, negatives, low_percent) for b in range(blocks))
    out = appended(rows.sparkSession, found, FOUND, "negatives-found")
    free(chosen, trees, dealt)
    return out


def contract_rows(embeddings: DataFrame) -> DataFrame:
    """Labels moved on by one, of ten, where vec_id is divisible by seven."""
    return embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


SQL = """
WITH sound AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a, sound b WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same AND other <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
