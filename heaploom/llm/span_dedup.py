"""Substring deduplication by sliding runs of consecutive sentences.

Every run of several consecutive sentences is hashed; runs that occur more than once in
the corpus are joined, and sentences that lie in any occurrence but the first are removed.

A sentence ends behind ``.``, ``!`` or ``?`` before white space, and at line ends. Sentences
of more than a dozen words are also cut behind words picked by their hash, so that a
passage yields the same pieces wherever it is put. A run has at least three pieces and at
least two dozen words, so short phrases that recur by chance are no repeated passage. Runs
begin at every piece and end at every piece, just long enough, so a repeated span is
covered from its first piece to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import bounded_batches, drop_keys, join_groups, prefilter
from heaploom.llm.words import WordHasher, mix64, power_tables, text_chunks
from heaploom.plans.staging import stage

RUN_SENTENCES, RUN_WORDS = 3, 24
LONG_SENTENCE, CUT_ONE_IN = 12, 4


class Sentences:
    """Pieces of a stretch of texts: for each its text, first byte, first word and number of words."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        self.stops = np.isin(np.arange(256), [ord(c) for c in ".!?"])

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        words, start, stop = self.hasher.spans(data, ends)
        text_of = np.searchsorted(ends, start, side="right")
        n = len(words)
        if not n:
            none = np.zeros(0, np.int64)
            return words, none, none, none
        lines = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
        last = self.stops[data[stop - 1]]
        last[:-1] |= (lines[start[1:]] > lines[stop[:-1]]) | (text_of[1:] != text_of[:-1])
        last[-1] = True
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        size = np.diff(np.concatenate([first, [n]]))
        last |= (np.repeat(size, size) > LONG_SENTENCE) & (words % np.uint64(CUT_ONE_IN) == 0)
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        return words, text_of[first], start[first], first

    def runs(self, data: np.ndarray, ends: np.ndarray, checked: bool = False) -> tuple[np.ndarray, ...]:
        """Per run: its text, the number of its first piece within the text, its pieces, its hash; ``checked``: another hash."""
        words, text_of, _, first = self.pieces(data, ends)
        n = len(words)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, none, *[none] * checked
        edges, k = np.concatenate([first, [n]]), np.arange(len(first))
        begin, end = np.searchsorted(text_of, text_of), np.searchsorted(text_of, text_of, side="right")
        ahead = np.maximum(k + RUN_SENTENCES, np.searchsorted(edges, first + RUN_WORDS, side="left"))
        back = np.minimum(k + 1 - RUN_SENTENCES, np.searchsorted(edges, edges[1:] - RUN_WORDS, side="right") - 1)
        starts, stops = ahead <= end, back >= begin
        pairs = np.unique(np.concatenate([k[starts] << 32 | ahead[starts], back[stops] << 32 | k[stops] + 1]))
        k, to = pairs >> 32, pairs & 0xFFFFFFFF
        a, b = edges[k], edges[to]
        out = [text_of[k], k - begin[k], to - k, self._hashes(words, a, b)]
        return *out, *[self._hashes(mix64(words + np.uint64(1)), a, b)] * checked

    @staticmethod
    def _hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        up, down = power_tables(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)


def _hashed(checked: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences()
        for b in batches:
            for at, data, ends in text_chunks(b.column(1)):
                text_of, piece, size, *hashes = sentences.runs(data, ends, checked)
                if not checked:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[0])], names=["_run"])
                    continue
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + text_of)), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)), *map(pa.array, hashes)], names=["_id", "_at", "_size", "_run", "_check"])

    return run


def _cleaned(key: str):  # noqa: ANN202
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences()
        for b in batches:
            gone = b.column(2).to_pylist()
            for at, data, ends in text_chunks(b.column(1)):
                _, text_of, first_byte, _ = sentences.pieces(data, ends)
                starts = np.concatenate([[0], ends[:-1]])
                rows = []
                for i, (lo, hi) in enumerate(zip(starts, ends)):
                    a, z = np.searchsorted(text_of, (i, i + 1))
                    drop = np.zeros(z - a, bool)
                    for r in gone[at + i] or ():
                        drop[r["_at"] : r["_at"] + r["_size"]] = True
                    edges = np.concatenate([first_byte[a:z], [hi]])
                    cuts = [(int(edges[j]), int(edges[j + 1])) for j in np.flatnonzero(drop)]
                    merged: list[list[int]] = []
                    for x, y in cuts:
                        if merged and merged[-1][1] == x:
                            merged[-1][1] = y
                        else:
                            merged.append([x, y])
                    kept, done = [], int(lo)
                    for x, y in merged:
                        kept.append(data[done:x])
                        done = y
                    kept.append(data[done:hi])
                    rows.append((np.concatenate(kept).tobytes().decode(), int(z - a), int(drop.sum()), sum(y - x for x, y in merged), [{"start": x - int(lo), "end": y - int(lo)} for x, y in merged]))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(rows)), pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], spans)], names=[key, "text", "n_sentences", "n_removed", "removed_bytes", "removed_spans"]
                )

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, text, n_sentences, n_removed, removed_bytes, removed_spans.

    ``text`` is what is left after the sentences of repeated runs are cut, with the white
    space behind them; ``removed_spans`` are byte ranges of the old text. The first
    occurrence of a run is that of the smallest key, then the earliest in the text; it
    stays, whatever repeats. Case of A-Z and the amount of white space make no difference.
    Null texts come back empty. Rows with a null key come back unchanged. Rows alike in
    key and text are one document, so their first occurrences coincide. Other columns
    are ignored, whatever their names.

    The first pass only counts hashes, added up before they are shuffled. The second makes
    the runs again and, behind a filter of bounded size, shuffles those that recur, which
    are told apart by two independent hashes of 64 bits. Texts
    with nothing to cut are not shuffled.
    """
    bounded_batches(docs)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    known = rows.where("_id is not null")
    repeated = stage(known.mapInArrow(_hashed(False), "_run bigint").groupBy("_run").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "spans-repeated")
    n_repeated, n_runs = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    runs = known.mapInArrow(_hashed(True), f"_id {kind}, _at int, _size int, _run bigint, _check bigint")
    again = stage(prefilter(runs, "_run", repeated, "_run", n_repeated).select("_id", "_at", "_size", F.struct("_run", "_check").alias("_span")), "spans-again")
    firsts = again.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_at")).alias("_first")).where("_n > 1")
    firsts = stage(firsts, "spans-firsts")
    later = join_groups(again, firsts, "_span", "_n", int(n_runs)).where("_first is not null and struct(_id, _at) != _first")
    cuts = stage(later.groupBy("_id").agg(F.collect_set(F.struct("_at", "_size")).alias("_cuts")), "spans-cuts")
    n_cuts = cuts.count()

    touched = prefilter(rows, "_id", cuts, "_id", n_cuts).join(cuts, "_id")
    untouched = drop_keys(rows, "_id", cuts, n_cuts)
    whole = touched.select("_id", "_text", "_cuts").unionByName(untouched.withColumn("_cuts", F.lit(None).cast(cuts.schema["_cuts"].dataType)))
    return whole.mapInArrow(_cleaned(key), f"`{key}` {kind}, text string, n_sentences bigint, n_removed bigint, removed_bytes bigint, removed_spans array<struct<start:bigint,end:bigint>>")

