"""Exact deduplication behind a two-pass Bloom filter. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import MAX_FILTER_WORDS, appended, ascii_lower, filter_words, join_groups, key_slots, test_filter
from heaploom.plans.staging import free, stage

#: Digests that share a block of the first filter, about. A block has 2**31 bits, so one single in 8,000 meets a set bit.
BLOCK_DIGESTS = 1 << 18
#: Digests to a range, for each 64-bit word that its second filter may have: 16 bits and more for each that recurs.
DIGESTS_A_WORD = 8


def digest_ranges(rows: DataFrame, n: int, max_filter_words: int = MAX_FILTER_WORDS, block_digests: int = BLOCK_DIGESTS) -> tuple[DataFrame, int]:
    """``rows`` (with ``_digest``), staged with ``_bit``, by ranges ``_range`` of the hash, and the number of ranges.

    ``_bit`` is the digest's place in the first filter: the number of its block, and one of the block's 2**31 bits.
    """
    ranges = max(1, -(-n // (DIGESTS_A_WORD * max_filter_words)))
    blocks = max(1, -(-n // block_digests))
    hashed = F.xxhash64("_digest")
    # a range is made of whole blocks
    block = F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(ranges * -(-blocks // ranges)))
    placed = rows.withColumn("_bit", F.shiftleft(block, 31).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 31) - 1)))).withColumn("_range", (block % ranges).cast("int"))
    return stage(placed, "exact-digests", by="_range"), ranges


def set_again(digests: DataFrame) -> DataFrame:
    """The bits ``_bit`` of the first filter that more than one row sets.

    Each task sends, for each block, one row: the numbers of the bits that it set, once each, and again those that it
    set more than once. So a row sent stands for many digests (all of a task that share a block), four bytes each,
    and copies of one text are two numbers a task, however many they are.
    """
    own = digests.select(F.spark_partition_id().alias("_task"), F.shiftright("_bit", 31).alias("_block"), F.col("_bit").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("_at"))
    packed = own.groupBy("_task", "_block").agg(F.sort_array(F.collect_list("_at")).alias("_set"))
    twice = F.filter("_set", lambda x, i: (i > 0) & (F.get("_set", i - 1) == x))
    sent = packed.select("_block", F.concat(F.array_distinct("_set"), F.array_distinct(twice)).alias("_set"))
    bits = sent.repartition("_block").select("_block", F.explode("_set").alias("_at"))
    # the rows of a block are together already, so this does not shuffle again
    return bits.groupBy("_block", "_at").count().where("count > 1").select(F.shiftleft("_block", 31).bitwiseOR(F.col("_at").cast("long")).alias("_bit"))


def maybe_repeated(digests: DataFrame, ranges: int, max_filter_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """``digests`` with ``_maybe``: false only where no other row has the digest.

    The bits that were set again make a filter for each range, which is broadcast alone and has ``max_filter_words``
    at most. A range is read from its own folder, so however many there are, a digest is tested once.
    """
    again = stage(set_again(digests).withColumn("_range", (F.shiftright("_bit", 31) % ranges).cast("int")), "exact-again", by="_range")
    sizes = {r["_range"]: r["count"] for r in again.groupBy("_range").count().collect()}

    def tested(one: int) -> DataFrame:
        words = filter_words(sizes.get(one, 0), max_filter_words)
        slots = key_slots(again.where(F.col("_range") == one), "_bit", words)
        return test_filter(digests.where(F.col("_range") == one).select("_id", "_digest", "_bit"), F.xxhash64("_bit"), slots, words).select("_id", "_digest", "_maybe")

    if ranges == 1:
        return stage(tested(0), "exact-tested")
    kind = digests.schema["_id"].dataType.simpleString()
    return appended(digests.sparkSession, map(tested, range(ranges)), f"_id {kind}, _digest binary, _maybe boolean", "exact-tested")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", max_filter_words: int = MAX_FILTER_WORDS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after lower-casing A-Z; null equals empty.
    The row with the largest key stays. Rows alike in key and text are one document
    given more than once: each counts in ``group_size`` and each of the largest key is
    kept. A null key is below all others. Other columns are ignored, whatever their names.

    Rows are counted, then texts are read once and become digests, written by ranges of their hash. The
    first pass puts every digest in a Bloom filter in blocks, which grows with the rows and is never held
    whole; it leaves the bits that were set again. The second pass tests each digest against
    these, range by range, by a broadcast filter of bounded size and bounded load. Only digests that pass are
    shuffled, to be counted exactly; the others are singles and go straight to the result.
    """
    n = docs.count()
    rows = docs.select(F.col(key).alias("_id"), F.unhex(F.sha2(F.coalesce(ascii_lower(F.col(text)), F.lit("")).cast("binary"), 256)).alias("_digest"))
    digests, ranges = digest_ranges(rows, n, max_filter_words)
    tested = maybe_repeated(digests, ranges, max_filter_words)
    free(digests)

    maybe = tested.where("_maybe").select("_id", "_digest")
    groups = maybe.groupBy("_digest").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = stage(groups, "exact-groups")
    sized = join_groups(maybe, groups, "_digest", "_n", n)
    single = tested.where("not _maybe").select("_digest", "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    found = sized.select("_digest", "_id", F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_n", F.lit(1).cast("long")).alias("_n")).unionByName(single)
    return found.select(
        F.col("_id").alias(key),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
