"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte n-grams, weighted by TF-IDF and normalised. Each
language has a few centroids, found by spherical k-means over a bounded sample of its
labelled texts; document frequencies come from all labelled texts. A text takes the
language of the nearest centroid by cosine, and counts as rejected when it is farther
from it than that centroid's own texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import bounded_batches

BUCKETS = 1 << 13
#: Labelled texts per language that the centroids are fitted to: about this many, twice as many at most.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
#: Sharpness of the score: the softmax of cosines divided by this.
TEMPERATURE = 0.05
_CHUNK = 1 << 18


class Grams:
    """Counts of hashed 2- and 3-grams of bytes; runs of anything but letters are one blank."""

    def __init__(self) -> None:
        b = np.arange(256)
        lower = np.where((b >= 65) & (b <= 90), b + 32, b)
        self.byte = np.where(((lower >= 97) & (lower <= 122)) | (b >= 128), lower, 32).astype(np.uint32)

    def count(self, data: np.ndarray) -> np.ndarray:
        """Counts of one text with a blank at either end, read in stretches: two symbols are carried over each seam."""
        out, tail, blank = np.zeros(BUCKETS, np.int64), np.array([32], np.uint32), np.array([32], np.uint32)
        for lo in range(0, max(len(data), 1), _CHUNK):
            x = np.concatenate([tail[-1:], self.byte[data[lo : lo + _CHUNK]], blank[: int(lo + _CHUNK >= len(data))]])
            x = np.concatenate([tail, x[1:][(x[1:] != 32) | (x[:-1] != 32)]])
            two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
            three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:] * np.uint32(0x27D4EB2F)
            for g in (two[len(tail) - 1 :], three):
                g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out += np.bincount(g >> np.uint32(32 - 13), minlength=BUCKETS)
            tail = x[-2:]
        return out

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            yield self.count(data[lo:hi])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.maximum(norm, 1e-9)


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids, and for each the least cosine that is usual in it."""
    seeds = [0]
    nearest = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9)
    close = x @ c.T
    own = close.argmax(axis=1)
    usual = [float(np.quantile(close[own == j, j], 0.01)) if (own == j).any() else 1.0 for j in range(len(c))]
    return c.astype(np.float32), np.array(usual)


@dataclass
class LanguageModel:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    usual: np.ndarray
    idf: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and rejection for each row of n-gram counts."""
        close = weigh(counts, self.idf) @ self.centroids.T
        by_language = np.stack([close[:, self.of == i].max(axis=1) for i in range(len(self.languages))], axis=1)
        best = by_language.argmax(axis=1)
        soft = np.exp((by_language - by_language.max(axis=1, keepdims=True)) / TEMPERATURE)
        nearest = close.argmax(axis=1)
        rejected = close[np.arange(len(close)), nearest] < 0.5 * self.usual[nearest]
        return best, 1.0 / soft.sum(axis=1), rejected


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", centroids: int = CENTROIDS, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """A model of the languages of ``labelled``; None if it has no text with a language.

    Frequencies are counted over all its rows; centroids see a sample per language that is
    chosen by a hash of the key, so refits agree. Keys may be null, repeated and of any type;
    rows without text or language are left out, and so are all other columns.
    """
    bounded_batches(labelled)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, n = Grams(), np.zeros(BUCKETS, np.int64), {}
        for b in batches:
            for counts in grams.texts(b.column(0)):
                df += counts > 0
            for x in b.column(1).to_pylist():
                n[x] = n.get(x, 0) + 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(some) + list(n), pa.string()), pa.array(list(some) + [-1] * len(n), pa.int64()), pa.array(list(df[some]) + list(n.values()), pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.select("_text", "_lang").mapInArrow(frequencies, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    sizes = {r["lang"]: r["n"] for r in counted if r["bucket"] < 0}
    if not sizes:
        return None
    df = np.zeros(BUCKETS)
    for r in counted:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1

    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int(min(1.0, per_language / v) * (1 << 20)))])
    sample = rows.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < share[F.col("_lang")])

    def clustered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_key", "_text"]).head(2 * per_language)
        x = weigh(np.stack(list(Grams().texts(pa.array(part["_text"], pa.string())))), idf)
        c, usual = kmeans(x, centroids)
        return pd.DataFrame({"lang": part["_lang"].iloc[0], "centroid": [v.tobytes() for v in c], "usual": usual})

    found = sorted(sample.groupBy("_lang").applyInPandas(clustered, "lang string, centroid binary, usual double").collect(), key=lambda r: (r["lang"], bytes(r["centroid"])))
    names = sorted({r["lang"] for r in found})
    return LanguageModel(names, np.array([names.index(r["lang"]) for r in found]), np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), np.array([r["usual"] for r in found]), idf)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id", reject: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, rejected.

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no letter,
    where nothing was learned, and with ``reject`` also where the nearest centroid is too
    far; ``score`` is then 0. Ties go to the language that is first by code point. Keys may
    be null, repeat and have any type; other columns are ignored; texts may have any length.
    No shuffle.
    """
    bounded_batches(docs)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                known = np.array(part.column(2).to_pylist(), bool) & (model is not None)
                lang, score, far = np.array(["und"] * len(known), object), np.zeros(len(known)), np.ones(len(known), bool)
                if model is not None and known.any():
                    best, s, rejected = model.predict(np.stack(list(grams.texts(part.column(1)))))
                    known &= ~(rejected & reject)
                    lang[known], score[known], far[known] = np.array(model.languages, object)[best[known]], s[known], rejected[known]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=[key, "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(key), F.col(text), letters.alias("_letters")).mapInArrow(predicted, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")
