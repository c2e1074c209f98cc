"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from heaploom.llm.common import word_count
from heaploom.plans.staging import stage

#: Rows of a source that are ordered in one task.
BUCKET_ROWS = 20_000
#: Sources that are broadcast; more are joined by their names.
MAX_SOURCES = 10_000


def _targets(sources: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Shares of the total by weight, none above ``max_repeats`` times its source: the level
    ``l`` with sum(min(cap, l * weight)) = total, found by running sums over cap / weight."""
    by_name = Window.orderBy("_no_source", "_source")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.select("*", weight.alias("_weight"), (F.col("source_size") * max_repeats).alias("_cap"))
    up = Window.orderBy("_ratio", "_no_source", "_source")
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    total, before = (lambda c: F.sum(c).over(Window.partitionBy(F.lit(1)))), (lambda c: F.coalesce(F.sum(c).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = (total("source_size") - before("_cap")) / (total("_weight") - before("_weight"))
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.col("_ratio") > F.col("_level"))
    common = F.min(F.when(F.col("_free"), F.struct("_ratio", "_no_source", "_source", "_level"))).over(Window.partitionBy(F.lit(1)))
    return ranked.select("_no_source", "_source", "source_size", F.when(F.col("_free"), common["_level"] * F.col("_weight")).otherwise(F.col("_cap").cast("double")).alias("target"))


def _not_after(finish: Column, repeat: int, last: Row | None, kind: DataType) -> Column:
    """Whether a place in the merged queue is at or before the last one taken."""
    if last is None:
        return F.lit(False)
    rest = F.struct(F.col("_key"), F.col("_tie"), F.lit(repeat)) <= F.struct(F.lit(last["_key"]), F.struct(F.lit(last["_tie"]["_id"]).cast(kind), F.lit(last["_tie"]["size"]).cast("long")), F.lit(last["repeat"]))
    return (finish < last["finish"]) | ((finish == last["finish"]) & rest)


def _keyed(docs: DataFrame, key: str, source: str) -> DataFrame:
    """``docs`` with its source (null apart) and its place in the source's queue, but for the size."""
    shuffled = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return docs.withColumns({"_no_source": F.col(source).isNull(), "_source": F.coalesce(F.col(source), F.lit("")), "_key": shuffled})


def cuts(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The sizes of ``docs`` (written), and per source its source_size, its target and for each pass the last place taken.

    Each source is a queue of its documents in shuffled order (by md5 of the key), pass
    after pass. A document's virtual finish time is what its queue has sent up to and with
    it, divided by the queue's target. All queues merge by finish time; the mix is the
    longest run from the front within the total size. Within a queue the order is that of
    places, so what is taken of it in a pass ends at one place: a row a source tells all.
    """
    sized = _keyed(docs.select(F.col(key).alias("_id"), F.col(source).alias("_s"), word_count(F.col(text)).alias("size")), "_id", "_s").drop("_s")
    sized = stage(sized, "mix-sizes")
    n = sized.count()
    buckets = max(1, -(-n // bucket_rows))
    placed = sized.where("size > 0").withColumns({"_bucket": (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"), "_tie": F.struct(F.col("_id"), F.col("size"))})

    source_key = ["_no_source", "_source"]
    parts = stage(placed.groupBy(*source_key, "_bucket").agg(F.sum("size").alias("_part")), "mix-parts")
    sources = sized.groupBy(*source_key).agg(F.sum("size").alias("source_size"))
    targets = stage(_targets(sources, weights, max_repeats), "mix-targets")
    before = F.sum("_part").over(Window.partitionBy(*source_key).orderBy("_bucket")) - F.col("_part")
    parts = parts.withColumn("_before", before).join(targets, source_key).drop("_part")
    queue = Window.partitionBy(*source_key, "_bucket").orderBy("_key", "_tie")
    placed = placed.withColumn("_sent", F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, 0))).join(parts, [*source_key, "_bucket"])
    placed = stage(placed.select(*source_key, "size", "source_size", "target", "_key", "_tie", (F.col("_before") + F.col("_sent")).alias("_sent")), "mix-placed")

    finishes = [(F.col("source_size") * r + F.col("_sent")) / F.col("target") for r in range(max_repeats)]
    waiting = placed.select("size", F.inline(F.array(*[F.struct(f.alias("finish"), F.col("_key"), F.col("_tie"), F.lit(r).alias("repeat")) for r, f in enumerate(finishes)])))
    slots = 4 * max(16, buckets)
    waiting = waiting.withColumn("_slot", F.least(F.lit(slots), F.floor(F.col("finish") * (slots // 4))))
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    slotted = waiting.groupBy("_slot").agg(F.sum("size").alias("_part")).withColumn("_upto", F.sum("_part").over(Window.orderBy("_slot")))
    edge = slotted.where(F.col("_upto") > total).agg(F.min("_slot").alias("slot"), F.min(F.struct("_slot", F.col("_upto") - F.col("_part"))).alias("before")).first()
    kind = placed.schema["_tie"].dataType["_id"].dataType
    if edge["slot"] is None:
        inside = [F.lit(True)] * max_repeats
    else:
        place = F.struct("finish", "_key", "_tie", "repeat")
        run = F.lit(edge["before"][1]) + F.sum("size").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        taken = waiting.where(F.col("_slot") == edge["slot"]).select(place.alias("_place"), run.alias("_run")).where(F.col("_run") <= total)
        last = taken.agg(F.max("_place").alias("p")).first()["p"] or waiting.where(F.col("_slot") < edge["slot"]).agg(F.max(place).alias("p")).first()["p"]
        inside = [_not_after(f, r, last, kind) for r, f in enumerate(finishes)]
    ends = placed.groupBy(*source_key).agg(*[F.max(F.when(i, F.struct("_key", "_tie"))).alias(f"_cut{r}") for r, i in enumerate(inside)])
    return sized, stage(targets.join(ends, source_key, "left").withColumn("_cuts", F.array(*[F.col(f"_cut{r}") for r in range(max_repeats)])).select(*source_key, "source_size", "target", "_cuts"), "mix-cuts")


def _taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` (_no_source, _source, _key, _id, size) with source_size, target and taken. Sources are broadcast while they are few."""
    few = ends.count() <= MAX_SOURCES
    met = rows.join(F.broadcast(ends) if few else ends, ["_no_source", "_source"])
    place = F.struct(F.col("_key"), F.struct(F.col("_id"), F.col("size")).alias("_tie"))
    passes = F.size(F.filter("_cuts", lambda c: c.isNotNull() & (place <= c)))
    return met.withColumn("taken", F.when(F.col("size") > 0, F.col("size") * passes).otherwise(0).cast("long")).drop("_cuts")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, taken.

    Sources take ``weights`` in turn, ordered by code point with null last, and share the
    size of all texts; no target exceeds ``max_repeats`` times its source, and what that
    leaves over is shared again by weight. A document's size is its number of words (null
    or empty: 0). ``taken`` is the size times the passes in which the mix takes it.

    Reruns agree, and each source is within a document of its target. Ties fall to the
    key, then the size; a repeated key is a document of its own. Tables without rows or
    words give ``target`` and ``taken`` 0. Other columns are ignored, whatever their names.

    Running sums over a hot source are made in buckets of its shuffle key with offsets
    from the buckets' sums, and the front of the merged queue is found from a histogram of
    finish times, so neither gathers a source or the corpus in one task. Windows without a
    partition run over sources and over slots of the histogram, one row each.
    """
    sized, ends = cuts(docs, key, source, text, weights, max_repeats, bucket_rows)
    return _taken(sized, ends).select(F.col("_id").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size and taken, which replace columns of these names. Texts are not shuffled."""
    _, ends = cuts(docs, key, source, text, weights, max_repeats)
    kept = [c for c in docs.columns if c not in ("size", "taken")]
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(key).alias("_id"), F.col(source).alias("_s"), word_count(F.col(text)).alias("size")), "_id", "_s").drop("_s")
    return _taken(rows, ends).where("taken > 0").select("_row.*", "size", "taken")


SQL = """
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
src0 AS (
  SELECT no_source, src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
src1 AS (
  SELECT *, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS INT)) AS w, 3 * source_size AS cap FROM src0),
src2 AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio FROM src1),
src3 AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
       / CAST(sum(w) OVER (ORDER BY ratio, no_source, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM src2),
targets AS (
  SELECT no_source, src, source_size, CASE WHEN ratio > lvl
    THEN (SELECT arg_min(lvl, (ratio, no_source, src)) FROM src3 WHERE ratio > lvl) * w ELSE CAST(cap AS DOUBLE) END AS target FROM src3),
queued AS (
  SELECT doc_id, size, k, source_size, target,
         CAST(sum(size) OVER (PARTITION BY no_source, src ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM sized JOIN targets USING (no_source, src)),
passes AS (
  SELECT doc_id, size, k, r, CAST(source_size * r + sent AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS r) WHERE size > 0),
merged AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, k, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS run FROM passes),
chosen AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM merged WHERE run <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN chosen USING (doc_id)
"""
