"""Counting quotient filters and phrase mining against plain counts."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heaploom.llm import phrases
from heaploom.llm import quotient_filter as cqf

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("bits", [2, 5, 9, 16, 21, 22, 31, 42])
def test_filters_give_back_what_was_counted(n, bits):
    rng = np.random.default_rng(bits)
    layout = cqf.Layout(n, bits, 3)
    want, parts = collections.Counter(), collections.defaultdict(list)
    for _ in range(4):
        ids = [np.r_[rng.integers(0, min(1 << bits, 40), 900), rng.integers(0, 1 << bits, 100), np.full(300, (1 << bits) - 1)] for _ in range(n)]
        want.update(zip(*(x.tolist() for x in ids), strict=True))
        for place, data in cqf.encode(layout, cqf.summed(*layout.permuted(ids))):
            parts[place].append((place, data))
    got = {}
    for place, slices in parts.items():
        merger = cqf.Merger(least=500)
        for s in slices:
            merger.add(cqf.decode(layout, *s))
        top, low, counts = merger.result()
        keys = list(zip(top.tolist(), [0] * len(top) if low is None else low.tolist(), strict=True))
        assert place < 8 and keys == sorted(set(keys))
        got.update(zip(zip(*(x.tolist() for x in layout.ids(top, low)), strict=True), counts.tolist(), strict=True))
    assert got == want


def plain(rows, least=10, inside=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in c.items() if len(q) > len(p) and b >= least and p in (q[:2], q[1:])]
            if len(p) == 3 or not any(100 * b >= inside * a for b in longer):
                found.append((" ".join(p), a, left, right, score))
        found.sort(key=lambda x: (-x[4], -x[1], x[0].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (p, a, left, right, s) in enumerate(found[:top], 1)]
    return sorted(out)


def awkward():
    rng = random.Random(3)
    words = ["new", "York", "CITY", "of", "the", "日本", "É", "a\x0bb", "x\x1cy", "ß"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", " ?! "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None]), text(rng.randint(0, 60))) for _ in range(80)]
    return rows + [("und", "the new york " * 12), ("en", None), ("en", ""), ("fr", " \t"), ("en", "." * 50), ("en", text(4000)), ("en", "of the " * 3000)] + [("de", "same words again")] * 15


def test_phrases_equal_plain_counts(spark, monkeypatch):
    rows = awkward()
    df = spark.createDataFrame(rows, "lang string, text string").select("*", F.lit(1).alias("word"), F.lit("b").alias("block"), F.lit(2).alias("n"))
    shown = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = lambda d, **k: sorted(tuple(r[c] for c in shown) for r in phrases.collocations(d, **k).collect())
    assert got(df) == plain(rows)
    assert got(df, min_count=3, inside_percent=80, top=7) == plain(rows, 3, 80, 7)
    # shares of a language and blocks that cut a text at the ends of its pieces change nothing
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    assert got(df.repartition(5), min_count=1, top=4) == plain(rows, 1, 50, 4)
    assert got(df.limit(0)) == [] and got(df.where("lang = 'fr'")) == []
