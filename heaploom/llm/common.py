"""What several operators share: word rules, a bounded Bloom filter, joins that stand hot keys."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heaploom.plans.staging import drop_path, shared_dir, stage

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)

#: 64-bit words of a broadcast filter at most, 64 to a row: 65,536 rows, under 40 MB.
MAX_FILTER_WORDS = 1 << 22
#: Keys with more than this share of the rows are hot; there can be 1000 of them at most.
HOT_SHARE = 1000


def bounded_batches(df: DataFrame) -> None:
    """Texts go to Python by 1,000 rows at a time, where the session leaves Spark's default of 10,000."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one; it goes when Python ends."""
    path = f"{shared_dir(spark)}/heaploom/{label}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, path)
    return path


def _gone(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended already
        return


def appended(spark: SparkSession, parts: Iterable[DataFrame], shape: str, label: str) -> DataFrame:
    """``parts`` written one after another to one table, so that no plan grows with their number."""
    path = shared_path(spark, label)
    spark.createDataFrame([], shape).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone. ``lower`` does just that for ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def filter_words(n: int, limit: int = MAX_FILTER_WORDS) -> int:
    """Words of a filter for ``n`` keys: 32 bits a key, a power of two, bounded."""
    return min(limit, 1 << max(10, (max(1, n) // 2 - 1).bit_length()))


def filter_slot(hashed: Column, words: int) -> tuple[Column, Column]:
    """Word and three-bit mask of a 64-bit hash in a register-blocked Bloom filter."""
    def bit(at: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, at).bitwiseAND(F.lit(63)).cast("int"))

    return hashed.bitwiseAND(F.lit(words - 1)), bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def test_filter(rows: DataFrame, hashed: Column, slots: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``_maybe``: whether the filter of the ``slots`` (_w, _m) may hold the hash.

    What is broadcast has ``words`` 64-bit words at most, however many slots there are; past
    its capacity it holds more hashes than it was given, never fewer.
    """
    merged = slots.groupBy("_w").agg(F.bit_or("_m").alias("_m")).groupBy(F.shiftright("_w", 6).alias("_b"))
    found = merged.agg(F.map_from_entries(F.collect_list(F.struct(F.col("_w").bitwiseAND(F.lit(63)).cast("int"), "_m"))).alias("_map"))
    bits = found.select("_b", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long"))).alias("_bits"))
    word, mask = filter_slot(hashed, words)
    names = [F.col(f"`{c}`") for c in rows.columns]
    tested = rows.withColumns({"_w": word, "_m": mask}).withColumn("_b", F.shiftright("_w", 6)).join(F.broadcast(bits), "_b", "left")
    held = F.get("_bits", F.col("_w").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.col("_m")) == F.col("_m")
    return tested.select(*names, F.coalesce(held, F.lit(False)).alias("_maybe"))


def key_slots(keys: DataFrame, key: str, words: int) -> DataFrame:
    word, mask = filter_slot(F.xxhash64(F.col(key)), words)
    return keys.select(word.alias("_w"), mask.alias("_m"))


def prefilter(rows: DataFrame, row_key: str, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows whose key may be among ``keys``: all that are, and few others."""
    words = filter_words(n_keys)
    return test_filter(rows, F.xxhash64(F.col(row_key)), key_slots(keys, key, words), words).where("_maybe").drop("_maybe")


def drop_keys(docs: DataFrame, key: str, dropped: DataFrame, n_dropped: int) -> DataFrame:
    """The rows of ``docs`` whose key is not in the column ``key`` of ``dropped``.

    Rows that a filter of bounded size clears stay where they are; only the others are
    shuffled to be compared exactly.
    """
    words = filter_words(n_dropped)
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"))
    gone = dropped.select(F.col(key).alias("_key"))
    tested = test_filter(rows, F.xxhash64("_key"), key_slots(gone, "_key", words), words)
    left = tested.where("_maybe").join(gone, "_key", "left_anti").select("_row")
    return tested.where("not _maybe").select("_row").unionByName(left).select("_row.*")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per key, with its number of rows).

    Keys that hold over a thousandth of the rows, a thousand at most, are broadcast so
    that their rows stay where they are; the others are shuffled, and no key fills a task.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > n_rows).withColumn("_hot", F.lit(True)))
    cold = groups.where(F.col(size) * HOT_SHARE <= n_rows)
    tagged = rows.join(hot, key, "left")
    return tagged.where("_hot").drop("_hot").unionByName(tagged.where("_hot is null").select(*rows.columns).join(cold, key, "left"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of the graph with links ``a``-``b``: rows (id, component).

    ``component`` is the smallest id that is reachable. Each round maps every node to its
    smallest neighbour and links to links between these; rounds end when no link is left,
    after a number of them that grows with the logarithm of the longest path. Every round
    starts from written tables, and a hub's links are added up before they are shuffled.
    """
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{label}-links")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("m")), f"{label}-round")
        if found is None:
            found = to.select(F.col("u").alias("id"), F.col("m").alias("component"))
        else:
            found = stage(found.join(to, found["component"] == to["u"], "left").select("id", F.coalesce("m", "component").alias("component")), f"{label}-found")
        left = edges.join(to, edges["a"] == to["u"]).select(F.col("m").alias("a"), "b")
        right = left.join(to, left["b"] == to["u"]).select("a", F.col("m").alias("b"))
        edges = stage(right.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{label}-links")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found
