"""Benchmark items inside documents: shared shingles, then exact similarity.

A run of words whose weighted Jaccard similarity with an item reaches the threshold holds
shingles of the item with at least that share of the item's weight. So it holds one of any
shingles that weigh more than the rest: the item's seeds, chosen rarest first. Every
shingle of every document is looked up among the seeds, and around those found, every run
that may reach the threshold is compared exactly. No run is missed, wherever it starts.

SimHash tables of the items (64-bit fingerprints, multi-index Hamming search) are made on
demand; the search does not depend on them, as a radius leaves out some runs at any threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heaploom.llm.common import bounded_batches
from heaploom.llm.words import WordHasher, mix64, shingles

RADIUS = 11
BLOCK_RADIUS = RADIUS // 4
#: Lengths within this ratio share a length of fingerprints.
LENGTH_RATIO = 1.12
#: Items whose nearness one table entry holds as bits; its tables fit a core's cache.
GROUP = 16
#: Low bits by which shingles that are no seeds are told apart at once.
SEED_BITS = 20
#: Items that are sent to the tasks at once, by number and by bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 8192, 16 << 20


def running(words: np.ndarray) -> np.ndarray:
    """Running sums of the 64 bits of each pair of neighbours in a sequence of word hashes.

    Four 16-bit sums lie in each integer; up to 65,535 words none reaches the next.
    """
    out = np.zeros((max(len(words), 1), 16), np.uint64)
    if len(words) > 1:
        pairs = mix64(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
        bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint16)
        np.cumsum(bits.view(np.uint64), axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """SimHashes of the windows of ``length`` words that start at ``at``: the majority of each bit."""
    ones = (sums[at + length - 1] - sums[at]).view(np.uint16)
    return np.packbits(ones > (length - 1) // 2, axis=1).view(np.uint64).ravel()


@dataclass
class Seeds:
    size: int  # words of a shingle
    hashes: np.ndarray  # sorted
    owners: np.ndarray  # the item of each
    hit: np.ndarray  # low bits of a hash -> whether a seed has them


@dataclass
class LengthClass:
    length: int
    items: list[int]
    prints: np.ndarray
    tables: np.ndarray  # group of items, block, value -> items as bits


class Benchmark:
    """Items ready to be searched for."""

    def __init__(self, ids: list, texts: list[str | None], size: int, min_words: int, threshold: float) -> None:
        self.size, self.threshold = size, threshold
        hasher = WordHasher()
        words: list[np.ndarray] = []
        for _, found, ends in hasher.documents(pa.array(texts, pa.string())):
            words += np.split(found, ends[:-1])
        keep = [i for i, w in enumerate(words) if len(w) >= max(min_words, 2)]
        self.ids, self.words = [ids[i] for i in keep], [words[i] for i in keep]
        seen, df = np.unique(np.concatenate([np.unique(w) for w in self.words]) if keep else np.zeros(0, np.uint64), return_counts=True)
        self.known, self.idf, self.rare = seen, np.log(1 + len(keep) / np.maximum(df, 1)), float(np.log(1 + len(keep)))
        self.sets = []
        for w in self.words:
            found, weights = self.weighted(w, size)
            found, first = np.unique(found, return_index=True)
            self.sets.append((found, weights[first]))
        self.seeds = self._seeds()

    def _seeds(self) -> list[Seeds]:
        """Per length of shingles (shorter than ``size`` for items of fewer words), the items' seeds."""
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by_size.setdefault(min(self.size, len(w)), []).append(i)
        out = []
        for size, items in sorted(by_size.items()):
            found, users = np.unique(np.concatenate([self.sets[i][0] for i in items]), return_counts=True)
            hashes, owners = [], []
            for i in items:
                mine, weights = self.sets[i]
                rarest = np.argsort(users[np.searchsorted(found, mine)], kind="stable")
                needed = np.searchsorted(np.cumsum(weights[rarest]), (1 - self.threshold + 1e-9) * weights.sum(), side="right") + 1
                hashes.append(mine[rarest[:needed]])
                owners.append(np.full(len(hashes[-1]), i))
            hashed, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(hashed, kind="stable")
            hit = np.zeros(1 << SEED_BITS, bool)
            hit[hashed & np.uint64((1 << SEED_BITS) - 1)] = True
            out.append(Seeds(size, hashed[order], owner[order], hit))
        return out

    def rarity(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, words)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == words, self.idf[at], self.rare) if len(self.known) else np.full(len(words), self.rare)

    def weighted(self, words: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of a sequence and their weights: the mean rarity of their words among the items."""
        size = size or self.size
        found, _ = shingles(words, np.array([len(words)]), size)
        take = min(size, len(words))
        sums = np.concatenate([[0.0], np.cumsum(self.rarity(words))])
        return found, (sums[take:] - sums[:-take])[: len(found)] / take

    @cached_property
    def classes(self) -> list[LengthClass]:
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            by_length.setdefault(len(w), []).append(i)
        out: list[LengthClass] = []
        for length in sorted(by_length):
            if out and length <= out[-1].length * LENGTH_RATIO:
                out[-1].items += by_length[length]
            else:
                out.append(LengthClass(length, list(by_length[length]), np.zeros(0, np.uint64), np.zeros(0)))
        values = np.arange(1 << 16, dtype=np.uint16)
        for c in out:
            prints = []
            for i in c.items:
                first = (len(self.words[i]) - c.length) // 2
                prints.append(fingerprints(running(self.words[i]), np.array([first]), c.length)[0])
            c.prints = np.array(prints, np.uint64)
            blocks = c.prints.view(np.uint16).reshape(-1, 4)
            c.tables = np.zeros((-(-len(c.items) // GROUP), 4, 1 << 16), np.uint16)
            for k in range(len(c.items)):
                for b in range(4):
                    c.tables[k // GROUP, b, np.bitwise_count(values ^ blocks[k, b]) <= BLOCK_RADIUS] |= np.uint16(1 << (k % GROUP))
        return out

    def similarity(self, item: int, words: np.ndarray) -> tuple[float, int]:
        """The best weighted Jaccard similarity, from the threshold on, of an item with a run of ``words``, and where that starts.

        Runs have the item's length; fewer words are one run. 0 if no run reaches the threshold.
        """
        mine, weights = self.sets[item]
        n = min(len(self.words[item]), len(words))
        size = min(self.size, len(self.words[item]))
        theirs, their_weights = self.weighted(words, size)
        span = max(n - size + 1, 1)
        at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        shared = np.concatenate([[0.0], np.cumsum(np.where(mine[at] == theirs, weights[at], 0.0))])
        whole = weights.sum()
        best = (0.0, 0)
        # what a run shares, repeats counted, is no less than what its set shares
        for at in np.flatnonzero(shared[span:] - shared[:-span] >= (self.threshold - 1e-9) * whole):
            window, kept = np.unique(theirs[at : at + span], return_index=True)
            total = their_weights[at : at + span][kept].sum() + whole
            common = weights[np.isin(mine, window, assume_unique=True)].sum()
            best = max(best, (round(float(common / (total - common)), 12), -int(at)))
            if best[0] >= 1.0:
                break
        return best[0], -best[1]

    def search(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """Verified leaks in texts laid end to end: text, item, similarity, first word."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for seeds in self.seeds:
            found, found_ends = shingles(words, ends, seeds.size)
            some = np.flatnonzero(seeds.hit[found & np.uint64((1 << SEED_BITS) - 1)])
            lo, hi = (np.searchsorted(seeds.hashes, found[some], side=side) for side in ("left", "right"))
            some, lo, n = some[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            item = seeds.owners[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            text = np.searchsorted(found_ends, some, side="right")
            first = some - np.concatenate([[0], found_ends])[text] + starts[text]
            text, first = np.repeat(text, n), np.repeat(first, n)
            order = np.lexsort((first, item, text))
            text, item, first = text[order], item[order], first[order]
            # seeds whose runs overlap are looked at together
            length = np.array([len(w) for w in self.words])[item]
            apart = np.ones(len(text), bool)
            apart[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (first[1:] - first[:-1] >= 2 * length[1:])
            at = np.flatnonzero(apart)
            tried: dict[tuple[int, int], tuple[float, int]] = {}
            for a, z in zip(at, np.append(at[1:], len(text)) - 1):
                t, i = int(text[a]), int(item[a])
                best = tried.get((t, i), (0.0, 0))
                if best[0] >= 1.0:
                    continue
                lo = max(int(starts[t]), int(first[a] + seeds.size - length[a]))
                score, where = self.similarity(i, words[lo : min(int(ends[t]), int(first[z] + length[a]))])
                if score > best[0]:
                    tried[t, i] = score, lo + where - int(starts[t])
            yield from ((t, i, *best) for (t, i), best in tried.items() if best[0] >= self.threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 8, key: str = "doc_id", text: str = "text", item: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item found in it: key, item_id, similarity, first_word.

    An item of ``n`` words is found where a run of ``n`` words of the document has a
    weighted Jaccard similarity of ``threshold`` or more with it, over shingles of ``size``
    words weighted by their words' rarity among all items; the best place is given, the
    first of equals the earliest. A document of fewer words than the item is one run.
    Words are as in near-duplicate search. Items under
    ``min_words`` words are not evidence of a leak and find nothing, null texts neither.
    A repeated item or document is found each time. An empty table on either side gives no
    rows; other columns are ignored.

    Keys of documents and items may be of any type, null or repeated.

    No shuffle: items are broadcast in blocks of bounded size, made ready once, each block
    with one pass over the documents; shingles are held for a stretch of text at a time.
    """
    bounded_batches(docs)
    items = benchmark.select(F.col(item).alias("_id"), F.col(text).alias("_text"))
    n, size_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-int(size_bytes) // BLOCK_BYTES))
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)) == block).orderBy("_id", "_text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark([r[0] for r in part], [r[1] for r in part], size, min_words, threshold))

        def searched(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            wanted, hasher = shared.value, WordHasher()
            for b in batches:
                for at, words, ends in hasher.documents(b.column(1)):
                    rows = list(wanted.search(words, ends))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([at + r[0] for r in rows], pa.int64())), pa.array([wanted.ids[r[1]] for r in rows], item_type), pa.array([float(r[2]) for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())],
                        names=[key, "item_id", "similarity", "first_word"],
                    )

        found = docs.select(key, text).mapInArrow(searched, f"`{key}` {kinds[0]}, item_id {kinds[1]}, similarity double, first_word bigint")
        out = found if out is None else out.unionByName(found)
    return out
