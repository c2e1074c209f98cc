"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard.

A signature takes two permutations: the first scatters the shingles of a document over
the integers below 2**32, and the second, shifted circularly by 0, 1, 2, ..., yields a
coordinate for each shift. Documents that agree on a band of coordinates are candidates,
which are brought to one place and linked by their full sets. Only verified links are
followed to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import bounded_batches, components, drop_keys, join_groups, prefilter
from heaploom.llm.words import WordHasher, mix64, shingles
from heaploom.plans.staging import stage

#: Bands and coordinates of each. A pair at Jaccard 0.8 shares no band with odds of 5e-6.
BANDS, BAND_ROWS = 24, 4
#: Shingles of candidates that meet their head in one part.
HEAD_SHINGLES = 100_000
#: Shingles of a band key's documents that are compared in one group; larger ones go in blocks.
BLOCK_SHINGLES = 500_000
#: Places of texts that are broadcast, about 10 MB; more are joined with the texts by key.
MAX_PLACES = 200_000


def permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the integers below 2**32; changes ``x`` in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(found: np.ndarray, starts: np.ndarray, n: int = BANDS * BAND_ROWS) -> np.ndarray:
    """``n`` coordinates for each stretch of shingle hashes that begins at ``starts``."""
    scattered = permute32((found >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((n, len(starts)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat(permute32(scattered + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35), starts)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every signature."""
    parts = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(sig), 0)
    for j in range(BAND_ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _sets(texts: pa.ChunkedArray, size: int, hasher: WordHasher) -> list[np.ndarray]:
    out = []
    for chunk in texts.chunks:
        for _, words, ends in hasher.documents(chunk):
            found, to = shingles(words, ends, size)
            out += [np.unique(x) for x in np.split(found, to[:-1])]
    return out


def _described(size: int):  # noqa: ANN202
    names = ["_id", "n_shingles", "_set", "_bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for at, words, ends in hasher.documents(b.column(1)):
                found, to = shingles(words, ends, size)
                starts = np.concatenate([[0], to[:-1]]).astype(np.int64)
                some = np.flatnonzero(to > starts)
                counts = np.zeros(len(to), np.int64)
                digest = np.zeros((len(to), 2), np.uint64)
                for i in some:
                    distinct = np.unique(found[starts[i] : to[i]])
                    counts[i] = len(distinct)
                    digest[i] = distinct.sum(dtype=np.uint64), mix64(distinct + np.uint64(1)).sum(dtype=np.uint64)
                keys = band_keys(signatures(found, starts[some])) if len(some) else np.zeros((0, BANDS), np.int64)
                where = np.zeros(len(to) + 1, np.int32)
                where[some + 1] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(to)),
                        pa.array(counts),
                        pa.array([x.tobytes() for x in digest], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(where), pa.int32()), pa.array(keys.ravel(), pa.int64())),
                    ],
                    names=names,
                )

    return run


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set that it is connected with by links of ``percent`` Jaccard or more.

    Every set is compared with the first; each that is not connected to it is then compared
    with all. So no link is missed but those between sets that the first links anyway.
    """
    n = len(sets)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)

    sizes = np.array([len(s) for s in sets], np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i + 1, n):
                if find(i) != find(j) and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                        join(i, j)
    else:
        owner = np.repeat(np.arange(n), sizes)
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(local, kind="stable")
        posted = owner[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(local))])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(n):
            if i and find(i) == find(0):
                continue
            mine = local[bounds[i] : bounds[i + 1]]
            lens = first[mine + 1] - first[mine]
            ends = np.cumsum(lens)
            at = np.arange(ends[-1]) + np.repeat(first[mine] - (ends - lens), lens)
            common = np.bincount(posted[at], minlength=n)
            for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)):
                join(i, int(j))
    return np.array([find(i) for i in range(n)])


def _verified(texts: DataFrame, placed: DataFrame, size: int, percent: int, kind: str, label: str) -> DataFrame:
    """Links (a, b) between the texts that are placed together (id, _group, _i, _j) and reach the similarity."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_id")
        ids = group.column("_id").combine_chunks()
        to = link(_sets(group.column("_text"), size, WordHasher()), percent)
        linked = np.flatnonzero(to != np.arange(len(to)))
        return pa.table({"a": ids.take(pa.array(to[linked])), "b": ids.take(pa.array(linked))})

    few = placed.count() <= MAX_PLACES
    together = texts.join(F.broadcast(placed) if few else placed, texts["_id"] == placed["id"]).select("_group", "_i", "_j", "_id", "_text")
    return stage(together.groupBy("_group", "_i", "_j").applyInArrow(run, f"a {kind}, b {kind}"), label)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES, head_shingles: int = HEAD_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Words are runs of anything but space and \\x09-\\x0D, with A-Z lower-cased. A document's
    set holds its distinct runs of ``size`` words, or all its words as one run if there are
    fewer; null texts and texts without words have an empty set and are linked with nothing.
    Two documents are linked when their sets' Jaccard similarity is ``percent`` or more, and
    ``component_id`` is the smallest key within reach, which alone is kept. A row with a null
    key is linked with nothing and kept, with null as component_id. Rows alike in key and text
    are one document. Other columns are ignored, whatever their names; keys are integers.

    Documents with one set are one candidate, whatever their number. The documents of a band
    key are candidates of each other, and nothing is closed over candidates that are not
    verified. First, every candidate meets the smallest document of all its band keys, in
    parts of bounded size that each hold that document; this links most copies. Then only
    band keys whose documents hang in several components, and were not all compared with
    each other before, are searched whole, or if large in blocks, each with each. So a text is
    sent once for its head, and once for each such band key.
    """
    bounded_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    described = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(_described(size), f"_id {kind}, n_shingles bigint, _set binary, _bands array<bigint>")
    described = stage(described, "near-signatures")
    n_docs = described.count()

    groups = described.where("n_shingles > 0 and _id is not null").groupBy("_set").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_n"), F.max("n_shingles").alias("_size"))
    groups = stage(groups, "near-sets")
    # of documents with one set only the first is banded; the others, once found, are left out
    several = join_groups(described.where("n_shingles > 0 and _id is not null").select("_id", "_set"), groups.where("_n > 1").select("_set", "_rep", "_n"), "_set", "_n", n_docs)
    copies = stage(several.where("_rep is not null and _id != _rep").select("_id").distinct(), "near-copies")
    reps = drop_keys(described.where("n_shingles > 0 and _id is not null").select("_id", "_bands"), "_id", copies, copies.count()).withColumnRenamed("_id", "_rep")
    banded = stage(reps.select("_rep", F.explode("_bands").alias("_band")), "near-bands")
    hashed = F.xxhash64("_rep")
    keys = banded.groupBy("_band").agg(F.min("_rep").alias("_head"), F.count(F.lit(1)).alias("_n"), F.bit_xor(hashed).alias("_x"), F.bit_xor(F.xxhash64(hashed)).alias("_y")).where("_n > 1")
    # of band keys with the same documents, one is enough
    keys = stage(keys.groupBy("_head", "_n", "_x", "_y").agg(F.min("_band").alias("_band")).select("_band", "_head", "_n"), "near-keys")
    n_banded = banded.count()
    members = join_groups(prefilter(banded, "_band", keys, "_band", keys.count()), keys, "_band", "_n", n_banded).where("_head is not null")
    sizes = groups.select("_rep", "_size").dropDuplicates(["_rep"])
    members = stage(members.join(sizes, "_rep"), "near-members")

    own = members.groupBy("_rep").agg(F.min("_head").alias("_head"), F.max("_size").alias("_size"))
    own = stage(own, "near-own")
    totals = stage(own.groupBy("_head").agg(F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_members")), "near-heads")
    n_own = own.count()
    parts = F.ceil(F.col("_total") / head_shingles).cast("int")
    placed = join_groups(own.select("_rep", "_head"), totals, "_head", "_members", n_own).select(F.col("_rep").alias("id"), F.col("_head").alias("_group"), F.pmod(F.xxhash64("_rep"), parts).cast("int").alias("_i"))
    heads = totals.select(F.col("_head").alias("id"), F.col("_head").alias("_group"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_i"))
    placed = stage(placed.where("id != _group").unionByName(heads).withColumn("_j", F.col("_i")), "near-places")
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    first = _verified(prefilter(texts, "_id", own, "_rep", n_own), placed, size, percent, kind, "near-first")
    rooted = components(first, "near-reached")

    known = members.select("_rep", "_band", "_head", "_n", "_size").join(rooted, members["_rep"] == rooted["id"], "left").drop("id")
    known = known.join(own.select("_rep", F.col("_head").alias("_own")), "_rep").join(totals.select(F.col("_head").alias("_own"), (parts == 1).alias("_whole")), "_own")
    compared = (F.col("_own") == F.col("_head")) & (F.col("_whole") | (F.col("_n") == 2))
    root = F.coalesce("component", "_rep")
    open_ = known.groupBy("_band").agg(F.min(root).alias("_low"), F.max(root).alias("_high"), F.every(compared).alias("_compared"), F.sum("_size").alias("_total"), F.count(F.lit(1)).alias("_members")).where("_low != _high and not _compared")
    open_ = stage(open_.select("_band", "_total", "_members"), "near-open")
    blocks = F.when(F.col("_total") <= block_shingles, F.lit(1)).otherwise(F.ceil(F.col("_total") * 2 / block_shingles)).cast("int")
    left = join_groups(prefilter(members.select("_rep", "_band"), "_band", open_, "_band", open_.count()), open_, "_band", "_members", n_banded).where("_total is not null")
    left = left.select(F.col("_rep").alias("id"), F.col("_band").alias("_group"), blocks.alias("_blocks")).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    left = left.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("id", "_group", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    left = stage(left, "near-left")
    ids = stage(left.select("id").distinct(), "near-left-ids")
    second = _verified(prefilter(texts, "_id", ids, "id", ids.count()), left, size, percent, kind, "near-second")

    found = components(first.unionByName(second), "near-linked").select(F.col("id").alias("_rep"), F.col("component").alias("_component"))
    named = groups.join(found, "_rep", "left").select("_set", "_n", F.coalesce("_component", "_rep").alias("_component"), "_rep").where("_n > 1 or _component != _rep")
    named = stage(named.select("_set", "_n", "_component"), "near-named")

    whole = join_groups(described.select("_id", "n_shingles", "_set"), named, "_set", "_n", n_docs)
    component = F.when(F.col("_id").isNotNull() & F.col("_component").isNotNull() & (F.col("n_shingles") > 0), F.col("_component")).otherwise(F.col("_id"))
    return whole.select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))
