"""Language-model scores by masked pseudo-likelihood.

A network predicts each word from the words around it, on both sides: sums over window
positions go through one hidden layer to a softmax in two steps, first over classes of
words, then over the places of the class. Frequent words have a place each, in order of
frequency; every other word shares a bucket's place, within which it has its share of the
bucket's uses in the whole corpus. So each conditional is a distribution over all words of
the corpus. A document's score is the sum of the log-probabilities of its words, each
masked in turn.

The network is trained in numpy on all documents. They are dealt to shards of bounded
number by a hash; each shard takes its steps in an order of its own, and after each round
the changes of all shards are averaged, weighted by the positions seen. How rows are
partitioned makes no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import bounded_batches, join_groups, prefilter
from heaploom.llm.words import WordHasher
from heaploom.plans.staging import stage

#: Classes of places, and places of a class; the last classes' places are buckets.
CLASSES, SIZE, BUCKET_CLASSES = 40, 40, 4
PLACES = CLASSES * SIZE
FREQUENT, BUCKETS = (CLASSES - BUCKET_CLASSES) * SIZE, BUCKET_CLASSES * SIZE
WINDOW, HIDDEN = 2, 16
#: Every position of the corpus is one example, in one of so many rounds.
ROUNDS = 2
RATE = 0.2
#: Examples of a step: at most so many, and so few that a shard takes STEPS of them in a round.
BATCH, LEAST_BATCH, STEPS = 16_384, 256, 128
#: No conditional is taken for less likely, and no logit for larger.
LEAST, LARGEST = np.float32(1e-30), np.float32(60)
_ONES = np.ones(max(CLASSES, SIZE), np.float32)
#: Documents of a shard, as long as there are not more than so many shards.
SHARD_DOCS, MAX_SHARDS = 4_000, 4096
#: Positions that a shard gathers before it takes steps on them.
GATHERED = 4 * BATCH
#: Words of buckets, most frequent first, whose uses tasks are told; those of rarer words are joined.
COMMON = 1 << 17
#: Rows in which a shard's changes are passed on.
PARTS = 256
_PAD = PLACES
#: Distinct words that a task counts before it passes its counts on.
COUNTED_AT_ONCE = 1 << 20


@dataclass
class Network:
    words: np.ndarray  # hashes of frequent words, sorted
    places: np.ndarray  # of these words
    near: np.ndarray  # (2 * WINDOW * (PLACES + 1), HIDDEN)
    hidden: np.ndarray  # (HIDDEN,)
    to_class: np.ndarray  # (HIDDEN, CLASSES)
    class_bias: np.ndarray  # (CLASSES,)
    to_place: np.ndarray  # (CLASSES, HIDDEN, SIZE)
    place_bias: np.ndarray  # (CLASSES, SIZE)

    @classmethod
    def start(cls, words: np.ndarray, counts: np.ndarray, buckets: np.ndarray) -> Network:
        """Without knowledge of contexts: biases are the logarithms of the counts of ``words``, most frequent first, and of the buckets."""
        rng = np.random.default_rng(7)
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        uses = np.concatenate([counts, np.zeros(FREQUENT - len(counts)), buckets]).reshape(CLASSES, SIZE)
        order = np.argsort(words)
        with np.errstate(divide="ignore"):
            classes = np.maximum(np.log(uses.sum(axis=1)), -1.0)
        return cls(words[order], order, normal(2 * WINDOW * (PLACES + 1), HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, CLASSES), (classes - classes.max()).astype(np.float32), normal(CLASSES, HIDDEN, SIZE), np.maximum(np.log((uses + 0.1) / (uses.sum(axis=1, keepdims=True) + 1)), -20).astype(np.float32))

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.near, self.hidden, self.to_class, self.class_bias, self.to_place, self.place_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def filled(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([x.size for x in self.parts])[:-1]
        return Network(self.words, self.places, *(x.astype(np.float32).reshape(p.shape) for x, p in zip(np.split(flat, cuts), self.parts)))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words."""
        rest = FREQUENT + (hashes >> np.uint64(40)) % np.uint64(BUCKETS)
        if not len(self.words):
            return rest.astype(np.uint16)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.places[at].astype(np.uint64), rest).astype(np.uint16)

    def context(self, tokens: np.ndarray, text_of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of ``near`` for the places around positions, with a pad beyond either end of their text."""
        out = np.empty((2 * WINDOW, len(at)), np.int64)
        for row, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
            p = at + d
            ok = (p >= 0) & (p < len(tokens))
            q = np.where(ok, p, 0)
            ok &= text_of[q] == text_of[at]
            out[row] = np.where(ok, tokens[q], _PAD) + row * (PLACES + 1)
        return out

    def reading(self, context: np.ndarray) -> np.ndarray:
        h = self.near[context.ravel()].reshape(*context.shape, HIDDEN).sum(axis=0)
        h += self.hidden
        return np.tanh(h, out=h)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, cuts = _by_class(target)
        target = target[order]
        h = self.reading(context[:, order])
        said, of = _logits(h @ self.to_class, self.class_bias)
        said = said[np.arange(len(target)), target // SIZE] - of
        for c, at in cuts:
            z, whole = _logits(h[at] @ self.to_place[c], self.place_bias[c])
            said[at] += z[np.arange(len(z)), target[at] % SIZE] - whole
        out = np.empty(len(target))
        out[order] = said
        return out


def _logits(z: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and the logarithm of what their exponentials add up to."""
    z += bias
    np.minimum(z, LARGEST, out=z)
    return z, np.log(np.maximum(np.exp(z) @ _ONES[: z.shape[1]], LEAST).astype(np.float64))


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place; what would pass the range of floats is held at its edge."""
    np.minimum(z, LARGEST, out=z)
    np.exp(z, out=z)
    z *= 1 / np.maximum(z @ _ONES[: z.shape[1]], LEAST)[:, None]
    return z


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of targets by class, and each class's part of it."""
    order = np.argsort(target, kind="stable")
    of = target[order] // SIZE
    edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    return order, [(int(of[a]), slice(int(a), int(z))) for a, z in zip(edges[:-1], edges[1:]) if z > a]


class Trainer:
    """Steps of a network, each parameter at a rate that falls with what it has moved (AdaGrad)."""

    def __init__(self, net: Network, rate: float) -> None:
        self.net, self.rate, self.moved = net, rate, [np.full(p.shape, 1e-6, np.float32) for p in net.parts]

    def _move(self, part: int, at: object, slope: np.ndarray) -> None:
        moved, values = self.moved[part], self.net.parts[part]
        now = moved[at] + slope * slope
        moved[at] = now
        values[at] -= self.rate * slope / np.sqrt(now)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, np.float32(len(target))
        order, cuts = _by_class(target)
        context, target = context[:, order], target[order]
        h = net.reading(context)
        p = _softmax(h @ net.to_class + net.class_bias)
        p[np.arange(len(target)), target // SIZE] -= 1
        p /= n
        back = p @ net.to_class.T
        self._move(2, ..., h.T @ p)
        self._move(3, ..., p.sum(axis=0))
        for c, at in cuts:
            p = _softmax(h[at] @ net.to_place[c] + net.place_bias[c])
            p[np.arange(len(p)), target[at] % SIZE] -= 1
            p /= n
            back[at] += p @ net.to_place[c].T
            self._move(4, c, h[at].T @ p)
            self._move(5, c, p.sum(axis=0))
        back *= 1 - h * h
        self._move(1, ..., back.sum(axis=0))
        read = context.ravel()
        order = np.argsort(read)
        first = np.concatenate([[0], np.flatnonzero(np.diff(read[order])) + 1])
        self._move(0, read[order[first]], np.add.reduceat(back[order % len(target)], first))


@dataclass
class Model:
    net: Network
    uses: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS))  # of all words of a bucket
    common: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.uint64), np.zeros(0)))  # words of buckets that tasks are told, sorted, and the logarithms of their uses
    rare: DataFrame | None = None  # (word, n): other words of buckets that are used more than once
    n_rare: int = 0


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    words, counts, held = [], [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        w, c = np.concatenate(words), np.concatenate(counts)
        distinct, at = np.unique(w, return_inverse=True)
        return distinct, np.bincount(at, weights=c, minlength=len(distinct)).astype(np.int64)

    def batch(w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["word", "n"])

    for b in batches:
        for _, found, _ in hasher.documents(b.column(0)):
            w, c = np.unique(found, return_counts=True)
            words.append(w)
            counts.append(c)
            held += len(w)
            if held > COUNTED_AT_ONCE:
                w, c = added()
                if len(w) > COUNTED_AT_ONCE // 2:
                    yield batch(w, c)
                    words, counts, held = [], [], 0
                else:
                    words, counts, held = [w], [c], len(w)
    if held:
        yield batch(*added())


def _averaged(part: pa.Table) -> pa.Table:
    """One part of the changes of all shards, weighted by the positions they have seen."""
    part = part.sort_by("shard")
    seen, total = part.column("seen").to_numpy(), None
    for n, x in zip(seen, part.column("x")):
        change = np.frombuffer(x.as_buffer(), np.float16).astype(np.float64) * n
        total = change if total is None else total + change
    return pa.table({"part": part.column("part").slice(0, 1), "x": [(total / max(seen.sum(), 1)).astype(np.float32).tobytes()]})


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, shard_docs: int = SHARD_DOCS) -> Model:
    """A model of all documents.

    Places come from word counts over the whole corpus, which are also kept for the words
    of the buckets. In each round a shard's examples are every ``rounds``-th position,
    from another one in each round, so every position is an example once. What is sent on
    are word counts and, from each shard, its parameters' changes.
    """
    bounded_batches(docs)
    counts = docs.select(F.col(text).alias("_text")).mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "lm-words")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    words, uses = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    if len(top) == FREQUENT:
        last = (int(uses[-1]), int(top.column("word")[FREQUENT - 1].as_py()))
        rest = counts.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    else:
        rest = counts.limit(0)
    bucket = F.shiftrightunsigned("word", 40) % BUCKETS
    buckets = np.zeros(BUCKETS)
    for r in rest.groupBy(bucket.cast("int").alias("b")).agg(F.sum("n").alias("n")).collect():
        buckets[r["b"]] = r["n"]
    told = rest.where("n > 1").orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    common = told.column("word").to_numpy().view(np.uint64)
    by_hash = np.argsort(common)
    common = common[by_hash], np.log(told.column("n").to_numpy()[by_hash])
    if len(told) == COMMON:
        last = (int(told.column("n")[-1].as_py()), int(told.column("word")[-1].as_py()))
        rare = rest.where("n > 1").where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    else:
        rare = rest.limit(0)
    rare = stage(rare, "lm-rare")
    net = Network.start(words, uses, buckets)

    shared = docs.sparkSession.sparkContext.broadcast(net)
    n_shards = min(MAX_SHARDS, max(1, -(-docs.count() // shard_docs)))
    batch = int(min(BATCH, max(LEAST_BATCH, (uses.sum() + buckets.sum()) / rounds / n_shards / STEPS)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            for at, found, ends in hasher.documents(b.column(2)):
                tokens, offsets = shared.value.tokens(found), pa.array(2 * np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), b.column(1).slice(at, len(ends)), pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(tokens)])], names=["shard", "at", "tokens"])

    row = F.xxhash64(F.col(key), F.col(text))
    dealt = docs.select(F.pmod(F.xxhash64(row), F.lit(n_shards)).cast("int").alias("shard"), row.alias("at"), F.col(text).alias("_text"))
    dealt = stage(dealt.mapInArrow(placed, "shard int, at bigint, tokens binary"), "lm-tokens")
    for r in range(rounds):
        here = docs.sparkSession.sparkContext.broadcast(net)

        def trained(batches: Iterator[pa.RecordBatch], r: int = r, here=here) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            shard, own, seen, held, n_held = None, None, 0, [], 0

            def steps() -> int:
                tokens = np.concatenate(held)
                text_of = np.repeat(np.arange(len(held)), [len(x) for x in held])
                chosen = np.flatnonzero(np.arange(len(tokens)) % rounds == r)
                for lo in range(0, len(chosen), batch):
                    at = chosen[lo : lo + batch]
                    own.step(own.net.context(tokens, text_of, at), tokens[at])
                return len(chosen)

            def changes() -> pa.RecordBatch:
                x = np.array_split((own.net.flat() - here.value.flat()).astype(np.float16), PARTS)
                return pa.RecordBatch.from_arrays([pa.array(np.full(PARTS, shard), pa.int32()), pa.array(np.arange(PARTS), pa.int32()), pa.array(np.full(PARTS, seen), pa.int64()), pa.array([p.tobytes() for p in x], pa.binary())], names=["shard", "part", "seen", "x"])

            for b in batches:
                for s, tokens in zip(b.column(0).to_pylist(), b.column(2)):
                    if s != shard:
                        if own is not None:
                            seen += steps() if held else 0
                            yield changes()
                        shard, own, seen, held, n_held = s, Trainer(here.value.filled(here.value.flat()), RATE), 0, [], 0
                    held.append(np.frombuffer(tokens.as_buffer(), np.uint16))
                    n_held += len(held[-1])
                    if n_held >= GATHERED:
                        seen += steps()
                        held, n_held = [], 0
            if own is not None:
                seen += steps() if held else 0
                yield changes()

        sent = dealt.where(F.length("tokens") > 0).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "at", "tokens").mapInArrow(trained, "shard int, part int, seen bigint, x binary")
        added = sent.groupBy("part").applyInArrow(_averaged, "part int, x binary").orderBy("part").toArrow()
        if len(added):
            net = net.filled(net.flat() + np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in added.column("x")]))
        here.destroy()
    shared.destroy()
    return Model(net, np.maximum(buckets, 1.0), common, rare, rare.count())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, log_likelihood, mean_log_likelihood.

    ``log_likelihood`` sums, over all words of the whole text, the log-probability of the
    word given up to two words on either side. A word that the corpus does not have counts
    as seen once. Null texts and texts without words have 0 tokens, 0 and a null mean. Keys
    may repeat, be null and of any type that can be hashed; other columns are ignored.

    The network's part needs no shuffle, nor do words in buckets whose uses tasks are told.
    Of the rarer ones, those that a filter of bounded size takes for words used more than
    once are shuffled, summed up per text, to meet their counts.
    """
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.net, np.log(model.uses), model.common))
    joins = model.n_rare > 0
    names = ["_key", "_name1", "_name2", "n_tokens", "_base", "_words", "_times"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        net, uses, (common, gain) = shared.value
        for b in batches:
            for at, found, ends in hasher.documents(b.column(3)):
                n = np.diff(np.concatenate([[0], ends]))
                text_of = np.repeat(np.arange(len(ends)), n)
                tokens = net.tokens(found)
                total = np.zeros(len(ends))
                for lo in range(0, len(tokens), BATCH):
                    places = np.arange(lo, min(lo + BATCH, len(tokens)))
                    said = net.log_probability(net.context(tokens, text_of, places), tokens[places])
                    total += np.bincount(text_of[places], weights=said, minlength=len(ends))
                rare = np.flatnonzero(tokens >= FREQUENT)
                total -= np.bincount(text_of[rare], weights=uses[tokens[rare] - FREQUENT], minlength=len(ends))
                if len(common):
                    at_ = np.minimum(np.searchsorted(common, found[rare]), len(common) - 1)
                    hit = common[at_] == found[rare]
                    total += np.bincount(text_of[rare[hit]], weights=gain[at_[hit]], minlength=len(ends))
                    rare = rare[~hit]
                rare = rare if joins else rare[:0]
                order = rare[np.lexsort((found[rare], text_of[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (text_of[order[1:]] != text_of[order[:-1]]) | (found[order[1:]] != found[order[:-1]])
                first = np.flatnonzero(new)
                offsets = pa.array(np.searchsorted(text_of[order[first]], np.arange(len(ends) + 1)), pa.int32())
                word, times = pa.array(found[order[first]].view(np.int64)), pa.array(np.diff(np.append(first, len(order))).astype(np.int32))
                kept = [b.column(i).slice(at, len(ends)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(total), pa.ListArray.from_arrays(offsets, word), pa.ListArray.from_arrays(offsets, times)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_name1"), F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias("_name2"), F.col(text).alias("_text"))
    rows = rows.mapInArrow(scored, f"_key {kind}, _name1 bigint, _name2 bigint, n_tokens bigint, _base double, _words array<bigint>, _times array<int>")
    if joins:
        # rows alike in key and text are one name: their sums are added up and shared again
        rows = stage(rows, "lm-scored")
        n_rows = rows.count()
        used = rows.select("_name1", "_name2", F.inline(F.arrays_zip("_words", "_times"))).withColumnRenamed("_words", "word")
        met = prefilter(used, "word", model.rare, "word", model.n_rare).join(model.rare, "word")
        gained = met.groupBy("_name1", "_name2").agg(F.sum(F.col("_times") * F.log("n")).alias("_gain"))
        alike = rows.groupBy("_name1", "_name2").agg(F.count(F.lit(1)).alias("_rows"))
        gained = stage(gained.join(alike, ["_name1", "_name2"]).select(F.struct("_name1", "_name2").alias("_name"), F.round(F.col("_gain") / F.col("_rows"), 9).alias("_gain"), "_rows"), "lm-gained")
        named = rows.select("_key", "n_tokens", "_base", F.struct("_name1", "_name2").alias("_name"))
        rows = join_groups(named, gained, "_name", "_rows", n_rows).withColumn("_base", F.col("_base") + F.coalesce("_gain", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("_base") / F.col("n_tokens"))
    return rows.select(F.col("_key").alias(key), "n_tokens", F.col("_base").alias("log_likelihood"), mean.alias("mean_log_likelihood"))
