"""Phrases whose words keep company, from exact n-gram counts in counting quotient filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heaploom.llm import quotient_filter as cqf
from heaploom.llm.common import bounded_batches
from heaploom.plans.staging import free, stage

#: Bytes of text that are coded together and make one filter.
BLOCK_BYTES = 8 << 20
#: N-grams that a range of quotients stands for, about; and bits of the number of a range.
RANGE_GRAMS, MIN_RANGE_BITS, MAX_RANGE_BITS = 1 << 21, 8, 16

_BREAK = ord(".")
_FOLD = bytes(_BREAK if chr(i) in ".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def coded(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words of ``text`` in their order (0: an end of a piece), the word of each code from 1, and its uses."""
    data = np.frombuffer(text.translate(_FOLD), np.uint8)
    solid, end = data != 32, data == _BREAK
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~solid[:-1] | end[:-1]
    first = solid & (before | end)
    place = np.cumsum(solid)
    offsets = np.append(place[first] - 1, place[-1:]).astype(np.int32)
    if len(offsets) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    codes, names = words.indices.to_numpy(), words.dictionary
    at = names.index(pa.scalar(b".", pa.binary())).as_py()
    if at >= 0:
        number = np.arange(1, len(names) + 1)
        number[at:] -= 1
        number[at] = 0
        codes, names = number[codes], pa.concat_arrays([names[:at], names[at + 1 :]])
    else:
        codes = codes + 1
    return codes, names, np.bincount(codes, minlength=len(names) + 1)[1:]


def _code_type(words: int) -> str:
    return "<u2" if words < 1 << 16 else "<u4"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, texts in waiting.items():
            codes, words, uses = coded(b".".join(texts))
            if len(words):
                uses_list = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(uses, pa.int64()))
                names = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string(), safe=False))
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([codes.astype(_code_type(len(words))).tobytes()], pa.binary()), names, uses_list], ["lang", "codes", "words", "uses"])
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            at = 0
            while at < len(raw):
                # a long text is cut where a piece ends, so that no phrase is cut
                to = len(raw) if len(raw) - at <= BLOCK_BYTES else _piece_end(raw, at + BLOCK_BYTES)
                waiting.setdefault(lang, []).append(bytes(raw[at:to]))
                size += to - at
                at = to
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
    yield from flush()


def _piece_end(raw: memoryview, at: int) -> int:
    while at < len(raw):
        found = bytes(raw[at : at + 4096]).translate(_FOLD).find(b".")
        if found >= 0:
            return at + found + 1
        at += 4096
    return len(raw)


def _filters(layouts: list[cqf.Layout]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                n_words, codes, known = (batch.column(i)[row] for i in range(3))
                number = np.zeros(n_words.as_py() + 1, np.int64)
                pairs = known.values
                number[pairs.field(0).to_numpy() + 1] = pairs.field(1).to_numpy()
                ids = number[np.frombuffer(codes.as_buffer(), _code_type(n_words.as_py()))]
                for layout in layouts:
                    n = layout.n
                    columns = [ids[i : len(ids) - n + 1 + i] for i in range(n)]
                    whole = np.logical_and.reduce([c != 0 for c in columns]) if len(ids) >= n else np.zeros(0, bool)
                    grams = [c[whole] for c in columns] if len(ids) >= n else []
                    if grams and len(grams[0]):
                        made = cqf.encode(layout, cqf.summed(*layout.permuted(grams)))
                        yield pa.RecordBatch.from_arrays([pa.array([n] * len(made), pa.int32()), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["n", "range", "filter"])

    return run


def _merge(layouts: list[cqf.Layout], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    by_n = {x.n: x for x in layouts}

    def emit(now: tuple[int, int], merger: cqf.Merger) -> Iterator[pa.RecordBatch]:
        top, low, counts = merger.result()
        often = counts >= least
        layout = by_n[now[0]]
        ids = layout.ids(top[often], None if low is None else low[often])
        n = int(often.sum())
        if n:
            columns = [pa.array(x, pa.int64()) for x in ids] + [pa.nulls(n, pa.int64())] * (3 - layout.n)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[often], pa.int64())], ["g1", "g2", "g3", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merger = None, None
        for batch in batches:
            for n, place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (n, place) != now:
                    if now is not None:
                        yield from emit(now, merger)
                    now, merger = (n, place), cqf.Merger()
                merger.add(cqf.decode(by_n[n], place, data.as_buffer()))
        if now is not None:
            yield from emit(now, merger)

    return run


def ngram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables, per language: the words (lang, word, f, gid) used ``min_count`` times at least,
    the n-grams (g1, g2, g3 or null, a) of two and three such words that are, and the uses of all words (lang, n).

    Texts are coded once, in blocks of BLOCK_BYTES of a language, each with a dictionary of its
    own. Word uses are added up over the blocks' dictionaries; a block is told the numbers of its
    own words only, so no dictionary of the corpus is broadcast. A word below ``min_count`` is in
    no n-gram that reaches it, so it ends a piece. Each block makes a filter, cut into ranges of
    quotients; a range of all blocks is merged in one task, range by range. The permutation
    deals n-grams out evenly, however skewed their counts are.
    """
    bounded_batches(docs)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = texts.mapInArrow(_blocks, "lang string, codes binary, words array<string>, uses array<bigint>")
    blocks = stage(blocks.withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")
    totals = stage(blocks.select("lang", F.aggregate("uses", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")

    uses = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "uses")).alias("pos", "_u")).select("block", "lang", "pos", F.col("_u.words").alias("word"), F.col("_u.uses").alias("f"))
    often = uses.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    numbered = stage(often.withColumns({"_p": F.spark_partition_id().cast("long"), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "phrase-words")
    parts = (numbered.agg(F.max("_p")).first()[0] or 0) + 1
    vocabulary = numbered.select("lang", "word", "f", (F.col("_i") * parts + F.col("_p") + 1).alias("gid"))

    bits = max(2, (vocabulary.agg(F.max("gid")).first()[0] or 0).bit_length())
    grams = totals.agg(F.sum("n")).first()[0] or 0
    ranges = min(MAX_RANGE_BITS, max(MIN_RANGE_BITS, (grams // RANGE_GRAMS).bit_length()))
    layouts = [cqf.Layout(n, bits, ranges) for n in (2, 3)]
    told = uses.select("block", "pos", "lang", "word").join(vocabulary, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "gid")).alias("known"))
    filters = blocks.select("block", F.size("words").alias("n_words"), "codes").join(told, "block").select("n_words", "codes", "known").mapInArrow(_filters(layouts), "n int, range int, filter binary")
    dealt = filters.repartition("n", "range").sortWithinPartitions("n", "range")
    found = stage(dealt.mapInArrow(_merge(layouts, min_count), "g1 bigint, g2 bigint, g3 bigint, a bigint"), "phrase-grams")
    free(blocks)
    return vocabulary, found, totals


def _score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (left right)), exact for counts below 10**16."""
    wide = "cast({} as decimal(19, 0))"
    a, left, right = (wide.format(x) for x in (a, left, right))
    return F.expr(f"1000000 * {a} * {a} div ({left} * {right})").cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 10, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into
    words at spaces and tabs. Phrases have two or three words and ``min_count`` uses at least,
    overlaps included. The score is floor(10**6 a a / (l r)) of the cut into two parts for which it
    is lowest (the first such cut). A phrase of two words goes where ``inside_percent`` of its uses
    or more lie in one phrase of three. Null texts are empty, a null language is ``und``; empty
    tables give no rows. Repeated rows count as often as they are given. Other columns are
    ignored, whatever their names. Counts are exact, up to 10**16.
    """
    vocabulary, grams, totals = ngram_counts(docs, text, lang, min_count)
    one = lambda i: vocabulary.select(F.col("gid").alias(f"g{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    pairs = grams.where("g3 is null").select("g1", "g2", "a").join(vocabulary.select(F.col("gid").alias("g1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1")), "g1").join(one(2), "g2")
    pairs = stage(pairs, "phrase-pairs")
    head = pairs.select("g1", "g2", "lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    tail = pairs.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    triples = grams.where("g3 is not null").join(head, ["g1", "g2"]).join(tail, ["g2", "g3"])
    triples = triples.withColumns({"_s1": _score("a", "f1", "f23"), "_s2": _score("a", "f12", "f3")}).withColumn("_second", F.col("_s2") < F.col("_s1"))
    triples = stage(triples.select("g1", "g2", "g3", "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(F.col("_second"), F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(F.col("_second"), F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("_s1", "_s2").alias("score")), "phrase-triples")

    within = triples.select("g1", "g2", "a").unionByName(triples.select(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "a")).groupBy("g1", "g2").agg(F.max("a").alias("_longer"))
    alone = pairs.join(within, ["g1", "g2"], "left").where((F.col("_longer") * 100 < F.col("a") * inside_percent) | F.col("_longer").isNull())
    shown = ["lang", "phrase", "a", "l", "r", "score"]
    found = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")).unionByName(triples.select(*shown))

    # the best of each share of a language, then the best of these, and so on, so that no language fills a task
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = -(-grams.count() // (8 * top))
    while shares > 1:
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        found = found.withColumn("_k", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("_k") <= top).drop("_k")
        shares = -(-shares // 8)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
f1 AS (SELECT lang, ws[i] AS x, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM places WHERE i < len(ws) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM places WHERE i + 1 < len(ws) GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f3.lang, f3.x, f3.y, f3.z, f3.f AS a, 1 AS k, p.f AS l, q.f AS r FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  UNION ALL
  SELECT f3.lang, f3.x, f3.y, f3.z, f3.f, 2, p.f, q.f FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
triples AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, x, y, z ORDER BY score, k) = 1),
inside AS (SELECT lang, x, y, max(a) AS longer FROM (SELECT lang, x, y, a FROM triples UNION ALL SELECT lang, y, z, a FROM triples) GROUP BY ALL),
pairs AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r, CAST(CAST(1000000 AS HUGEINT) * f2.f * f2.f // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  LEFT JOIN inside i ON i.lang = f2.lang AND i.x = f2.x AND i.y = f2.y WHERE i.longer IS NULL OR 100 * i.longer < 50 * f2.f),
found AS (SELECT * FROM pairs UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, l, r, score FROM triples),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
