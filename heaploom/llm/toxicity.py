"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words and beginnings of words; a text's vector has their numbers of uses times
their weights, at unit length. A term weighs the more, the rarer it is in the corpus and
the further apart the two classes use it; none is left out. Examples are entries of an
inverted index: frequent terms keep their weights block by block, with the largest of each
block as its bound, other terms keep postings. Blocks whose bound does not reach the
nearest examples so far are passed over, so the neighbours are exact. Their votes, weighted
by nearness, are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import bounded_batches
from heaploom.llm.words import mix64, power_tables, text_chunks
from heaploom.plans.staging import stage

#: Labelled rows that are learned from: about this many, chosen by a hash of the key.
SAMPLE = 4_000
#: Bytes of the beginnings of words that are terms beside the words.
BEGINNING = 6
#: Standard errors that are added to the distance of the classes, so that every term weighs something.
FLOOR = 0.1
#: Words that are added to a text's length when rates of use are compared.
SHORT = 20
NEIGHBOURS = 15
#: Entries of a block, and cells in which frequent terms are kept by block.
BLOCK, CELLS = 64, 1 << 22
#: Texts that are searched for at once, and blocks of each that are tried before any is passed over.
AT_ONCE, FIRST_BLOCKS = 64, 4
THRESHOLD = 0.7


class Terms:
    """Hashes of the terms in texts laid end to end. Words are runs of letters; A-Z are lower-cased."""

    def __init__(self) -> None:
        b = np.arange(256)
        lower = np.where((b >= 65) & (b <= 90), b + 32, b)
        self.letter = ((lower >= 97) & (lower <= 122)) | (b >= 128)
        self.value = (lower + 1).astype(np.uint64)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and hash of each term, words first, and the number of words of each text."""
        n = len(data)
        up, down = power_tables(n + 1)
        solid = np.zeros(n + 1, bool)
        solid[:n] = self.letter[data]
        first, last = solid[:n].copy(), solid[:n] & ~solid[1:]
        first[1:] &= ~solid[: n - 1]
        cuts = ends[(ends > 0) & (ends < n)]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * up[:n], out=sums[1:])
        text_of = np.searchsorted(ends, start, side="right")
        whole = mix64((sums[stop] - sums[start]) * down[start])
        long = np.flatnonzero(stop - start >= BEGINNING)
        begun = mix64((sums[start[long] + BEGINNING] - sums[start[long]]) * down[start[long]] + np.uint64(1))
        return np.concatenate([text_of, text_of[long]]), np.concatenate([whole, begun]), np.bincount(text_of, minlength=len(ends))


class Vocabulary:
    """Places of hashes in a sorted array of them, looked up from their highest bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    @cached_property
    def first(self) -> tuple[np.uint64, np.ndarray]:
        bits = len(self.hashes).bit_length() + 2
        shift = np.uint64(64 - bits)
        edges = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift)
        return shift, np.append(edges, len(self.hashes)).astype(np.int32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for those that are not known."""
        shift, first = self.first
        top = (hashes >> shift).astype(np.int64)
        at, stop, out = first[top], first[top + 1], np.full(len(hashes), -1, np.int64)
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            same = self.hashes[here] == hashes[left]
            out[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


def counted(text_of: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of uses, ordered by text and term; terms below 0 are left out."""
    known = term >= 0
    pairs, n = np.unique(text_of[known] << 32 | term[known], return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, n


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at ``start`` and are ``n`` long, end to end."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among sparse unit vectors without negative weights."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> None:
        """Entry ``i`` has the terms and weights from ``ptr[i]`` to ``ptr[i + 1]``."""
        self.n, self.blocks = len(ptr) - 1, -(-(len(ptr) - 1) // BLOCK)
        uses = np.bincount(terms, minlength=n_terms)
        frequent = np.argsort(-uses, kind="stable")[: CELLS // max(1, self.blocks * BLOCK)]
        frequent = frequent[uses[frequent] > self.blocks]
        self.slot = np.full(n_terms, -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        entry = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))
        slot = self.slot[terms]
        dense = slot >= 0
        self.dense = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        self.dense[entry[dense] // BLOCK, slot[dense], entry[dense] % BLOCK] = weights[dense]
        self.bound = self.dense.max(axis=2).T.copy() if self.blocks else np.zeros((len(frequent), 0), np.float32)
        order = np.flatnonzero(~dense)[np.argsort(terms[~dense], kind="stable")]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(terms[order], minlength=n_terms))])
        self.entry, self.weight = entry[order], weights[order].astype(np.float32)

    def nearest(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query (laid out as the entries are) its ``k`` entries of the largest positive cosine, and these; ties by entry."""
        for lo in range(0, len(ptr) - 1, AT_ONCE):
            some = ptr[lo : lo + AT_ONCE + 1]
            score = self._scores(some - some[0], terms[some[0] : some[-1]], weights[some[0] : some[-1]], k)
            for row in score:
                least = np.partition(row, len(row) - k)[-k] if len(row) > k else 0.0
                found = np.flatnonzero((row > 0) & (row >= least))
                found = found[np.lexsort((found, -row[found]))][:k]
                yield found, row[found]

    def _scores(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
        """Cosines of queries with all entries; 0 in blocks that cannot hold one of the ``k`` nearest."""
        n, wide = len(ptr) - 1, self.blocks * BLOCK
        query = np.repeat(np.arange(n), np.diff(ptr))
        slot = self.slot[terms]
        rare = slot < 0
        start = self.ptr[terms[rare]]
        many = self.ptr[terms[rare] + 1] - start
        at = spread(start, many)
        score = np.bincount(np.repeat(query[rare] * wide, many) + self.entry[at], self.weight[at] * np.repeat(weights[rare], many), minlength=n * wide).astype(np.float64, copy=False)
        if not self.bound.shape[0] or not self.blocks:
            return score.reshape(n, wide)[:, : self.n].round(6)
        score = score.reshape(n, self.blocks, BLOCK)
        mine = np.zeros((n, self.bound.shape[0]), np.float32)
        mine[query[~rare], slot[~rare]] = weights[~rare]
        may = score.max(axis=2) + (mine @ self.bound) * (1 + 1e-4) + 1e-6
        done = np.zeros(may.shape, bool)
        best = np.argsort(-may, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        np.put_along_axis(done, best, True, axis=1)
        self._add(score, mine, done)
        flat = score.reshape(n, wide)
        least = np.partition(flat, wide - k, axis=1)[:, -k] if wide > k else np.zeros(n)
        more = (may >= least[:, None]) & ~done
        self._add(score, mine, more)
        score[~(done | more)] = 0
        return flat[:, : self.n].round(6)

    def _add(self, score: np.ndarray, mine: np.ndarray, wanted: np.ndarray) -> None:
        for block in np.flatnonzero(wanted.any(axis=0)):
            rows = np.flatnonzero(wanted[:, block])
            score[rows, block] += mine[rows] @ self.dense[block]


@dataclass
class ToxicityModel:
    prior: float
    silent: float  # score of a text without a term of an example
    words: Vocabulary = field(default_factory=lambda: Vocabulary(np.zeros(0, np.uint64)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    ids: pa.Array | None = None  # keys of the examples, as evidence
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def vectors(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of texts by their terms' numbers of uses. Terms of no example are left out: they meet none and change no order."""
        w = n * self.weights[term]
        length = np.sqrt(np.bincount(text, w * w, minlength=n_texts))
        return np.searchsorted(text, np.arange(n_texts + 1)), term, (w / length[text]).astype(np.float32)

    def vote(self, entries: np.ndarray, cosines: np.ndarray) -> float:
        """Toxic share among the neighbours, each weighing by its nearness."""
        if not len(entries):
            return self.prior
        w = 1 / (0.02 + np.maximum(0, 1 - cosines))
        return float((w * self.toxic[entries]).sum() / w.sum())

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression of the label on each example's vote by the others."""
        blocks: list[list[float]] = []
        for v in np.unique(votes):
            here = labels[votes == v]
            blocks.append([v, float(here.sum()), float(len(here)), v])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], blocks[-1][1] + last[1], blocks[-1][2] + last[2], last[3]]
        at = np.array([x for b in blocks for x in (b[0], b[3])])
        rate = np.array([(b[1] + self.prior) / (b[2] + 1) for b in blocks for _ in range(2)])
        self.steps = at, np.maximum.accumulate(rate) if len(rate) else rate

    def score(self, entries: np.ndarray, cosines: np.ndarray) -> float:
        if not len(entries):
            return self.silent
        return float(np.clip(np.interp(self.vote(entries, cosines), *self.steps), 0.0, 1.0)) if len(self.steps[0]) else self.prior


def _thinned(rows: DataFrame, sample: int, *by: str) -> DataFrame:
    n = rows.count()
    return rows if n <= sample else rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 24)) < int(sample / n * (1 << 24)))


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per example its terms, their numbers of uses, and its number of words."""
    terms = Terms()
    for b in batches:
        for at, data, ends in text_chunks(b.column(1)):
            text_of, hashed, n_words = terms(data, ends)
            distinct, which = np.unique(hashed, return_inverse=True)
            text, which, n = counted(text_of, which)
            cuts = np.searchsorted(text, np.arange(1, len(ends)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, len(ends)), b.column(2).slice(at, len(ends)), pa.array([x.tobytes() for x in np.split(distinct[which], cuts)], pa.binary()), pa.array([x.tobytes() for x in np.split(n.astype(np.int32), cuts)], pa.binary()), pa.array(n_words)],
                names=["_id", "_y", "_terms", "_n", "_words"],
            )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, k: int = NEIGHBOURS) -> ToxicityModel | None:
    """A model from the texts that ``labels`` (key, label) calls 0 or 1; None if there is none.

    Examples are a sample of about ``sample`` labelled keys at most, chosen by a hash of
    the key, whose labels are broadcast; what they make up on the driver is bounded by it.
    How many documents use a term is counted over all of ``docs``. Null keys and other
    labels are ignored; a key may be labelled both ways, and a key that ``docs`` repeats is
    as many examples, thinned by a hash of the text if these are over ``sample``. Keys may
    be of any type that both tables share. Any order of rows gives the same model.
    """
    bounded_batches(docs)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    known = F.broadcast(_thinned(stage(known, "toxicity-labels"), sample, "_id"))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(known, "_id").select("_id", "_text", "_y")
    rows = stage(_thinned(stage(rows, "toxicity-sample"), sample + sample // 8, "_id", "_text", "_y"), "toxicity-examples")
    kind = rows.schema["_id"].dataType.simpleString()
    told = rows.mapInArrow(_uses, f"_id {kind}, _y int, _terms binary, _n binary, _words bigint").toArrow()
    toxic = told.column("_y").to_numpy().astype(np.int64)
    n = np.bincount(toxic, minlength=2)
    if not n.sum():
        return None
    prior = (n[1] + 0.5) / (n.sum() + 1)
    model = ToxicityModel(prior, prior)
    if not n[0] or not n[1]:
        return model

    ids, words = told.column("_id").combine_chunks(), told.column("_words").to_numpy()
    hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in told.column("_terms")]
    uses = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in told.column("_n")])
    sizes, name = np.array([len(h) for h in hashes]), [hashlib.blake2b(h, digest_size=8).digest() for h in hashes]
    hashes = np.concatenate(hashes)
    del told
    distinct, term = np.unique(hashes, return_inverse=True)
    term, entry = term.astype(np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    del hashes
    rate, y = uses / (words[entry] + SHORT), toxic[entry]
    totals = [np.bincount(term[y == c], rate[y == c], minlength=len(distinct)) for c in (0, 1)]
    variance = np.bincount(term, rate * rate, minlength=len(distinct)) / n.sum() - ((totals[0] + totals[1]) / n.sum()) ** 2
    once = (1 / (words.mean() + SHORT)) ** 2 / n.sum()
    apart = np.abs(totals[1] / n[1] - totals[0] / n[0]) / np.sqrt((variance + once) * (1 / n[0] + 1 / n[1]))

    del rate, y, totals, variance
    context = docs.sparkSession.sparkContext
    model.words = Vocabulary(distinct)
    wanted = context.broadcast(model.words)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df = Terms(), np.zeros(len(wanted.value.hashes), np.int64)
        for b in batches:
            for _, data, ends in text_chunks(b.column(0)):
                text_of, hashed, _ = terms(data, ends)
                df += np.bincount(counted(text_of, wanted.value.places(hashed))[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["i", "n"])

    every = docs.select(F.col(text).alias("_text")).mapInArrow(used, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(distinct))
    df[every.column("i").to_numpy()] = every.column("n").to_numpy()
    model.weights = np.log1p(docs.count() / (1 + df)) * (FLOOR + apart)
    wanted.destroy()

    # entries of the same heaviest term lie together, others by their terms, so blocks have tight bounds
    ptr, _, weights = model.vectors(entry, term, uses, len(sizes))
    heaviest = np.full(len(sizes), -1)
    by_weight = np.lexsort((term, weights, entry))
    ends = np.cumsum(sizes)
    some = np.flatnonzero(sizes)
    heaviest[some] = term[by_weight[ends[some] - 1]]
    order = np.array(sorted(some, key=lambda i: (heaviest[i], name[i], toxic[i])), np.int64)
    at = spread(ptr[order], sizes[order])
    rows_ptr, rows_term, rows_weight = np.concatenate([[0], np.cumsum(sizes[order])]), term[at], weights[at]
    model.ids, model.toxic = ids.take(pa.array(order)), toxic[order]
    model.index = BlockMaxIndex(rows_ptr, rows_term, rows_weight, len(distinct))
    none = toxic[sizes == 0]
    del ptr, weights, by_weight, entry, term, uses, at
    model.silent = min(prior, (none.sum() + 0.5) / (len(none) + 1))
    shared, entries = context.broadcast(model), context.broadcast((rows_ptr, rows_term, rows_weight))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ptr, term, weight), m = entries.value, shared.value
        for b in batches:
            mine = b.column(0).to_numpy()
            n = ptr[mine + 1] - ptr[mine]
            at = spread(ptr[mine], n)
            near = m.index.nearest(np.concatenate([[0], np.cumsum(n)]), term[at], weight[at], k + 1)
            votes = [m.vote(e[e != i][:k], c[e != i][:k]) for i, (e, c) in zip(mine, near)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64())], names=["entry", "vote"])

    votes = docs.sparkSession.range(0, len(order), 1, context.defaultParallelism).mapInArrow(voted, "entry bigint, vote double").toArrow()
    model.calibrate(np.round(votes.column("vote").to_numpy(), 6), model.toxic[votes.column("entry").to_numpy()])
    shared.destroy()
    entries.destroy()
    return model


def score(docs: DataFrame, model: ToxicityModel | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = NEIGHBOURS, leave_out: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, score, predicted, evidence.

    ``score`` estimates the chance of label 1 and ``predicted`` is 1 from ``threshold`` on.
    ``evidence`` lists the keys of up to three of the nearest labelled examples. Texts
    without a term of an example, null and empty ones among them, score the rate of
    examples without terms, but no more than that of all; without a model all score 0.
    With ``leave_out`` no row meets an example of its own key, so a label never takes part in
    the score of the row that it is of, as in calibration; copies under other keys do. Keys may repeat, be null and of any type, texts may have any length, other columns are
    ignored. No shuffle; the model is bounded by its sample.
    """
    bounded_batches(docs)
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    id_type = model.ids.type if model is not None and model.ids is not None else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), held.value
        own: dict[object, list[int]] = {}
        if leave_out and id_type is not None:
            for place, name in enumerate(m.ids.to_pylist()):
                own.setdefault(name, []).append(place)
        more = max(map(len, own.values()), default=0)
        for b in batches:
            keys = b.column(0).to_pylist() if own else []
            value, where, why = np.full(b.num_rows, m.silent if m is not None else 0.0), [0], []
            if m is not None and m.index is not None:
                for at, data, ends in text_chunks(b.column(1)):
                    text_of, hashed, _ = terms(data, ends)
                    near = m.index.nearest(*m.vectors(*counted(text_of, m.words.places(hashed)), len(ends)), k + more)
                    for i, (entries, cosines) in enumerate(near):
                        if own:
                            others = ~np.isin(entries, own.get(keys[at + i], []))
                            entries, cosines = entries[others][:k], cosines[others][:k]
                        value[at + i] = m.score(entries, cosines)
                        why.append(entries[:3])
                        where.append(where[-1] + len(why[-1]))
            where += [where[-1]] * (b.num_rows + 1 - len(where))
            shown = m.ids.take(pa.array(np.concatenate(why))) if id_type is not None and why else pa.array([], id_type or b.column(0).type)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.ListArray.from_arrays(pa.array(where, pa.int32()), shown)], names=[key, "score", "predicted", "evidence"])

    return docs.select(key, text).mapInArrow(scored, f"`{key}` {kind}, score double, predicted int, evidence array<{kind}>")


def learnable(labels: DataFrame, key: str = "doc_id", label: str = "toxic", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Labels outside the held-out fold, which is told by crc32 of the key as text."""
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    return labels.where((fold != held_out) & F.col(label).isNotNull()).select(key, label)
