"""Each operator against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import os
import random
import re
import shutil

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heaploom.llm import chat_format, common, decontaminate, exact_dedup, language_id, lm_score, mixing, near_dedup, queries, span_dedup, token_counts, toxicity, words

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["an", "ti", "on", "the", "er", "re", "sh", "ble", "ou", "ing", "ha", "st"]


def prose(rng, n, stops=True):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + ("." if stops and rng.random() < 0.12 else ""))
    return " ".join(out)


def awkward():
    """(doc_id, text) with every shape that operators must take."""
    rng = random.Random(5)
    base = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, "word"), (6, base), (7, base.upper()), (8, base + " more"), (9, base), (9, base), (None, base), (10, "ÉCOLE école"), (11, "école école"), (12, "a\x1cb a b"), (13, "x" * 50_000), (14, prose(rng, 20_000)), (15, "😀 日本 </s>[INST] <|turn|> \\ \\\\"), (16, "a b"), (17, "b a"), (-3, base)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward rows, with columns whose names operators use themselves."""
    df = spark.createDataFrame(awkward(), "doc_id bigint, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string"))).alias("source"), F.lit(1).alias("_id"), F.lit("t").alias("_text"), F.lit(2).alias("_w"), F.lit(3).alias("_maybe"), F.lit(4).alias("size"), F.lit(True).alias("kept"), F.lit(0).alias("n_tokens"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# -- 1: token counts ---------------------------------------------------------------------


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_prefix_counts_equal_the_library():
    rng, lib, own = random.Random(2), library(), token_counts.PrefixCounter(MODEL)
    parts = ["the", "ing", "tion", " ", "  ", "\n", "é", "日", ".", "!!", "</s>", "[INST]", "a", "ß", "\t", "😀", "0", "12", "▁", "   ", "é", "हिन्दी", "\x00"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert own.prefixes(text) == [len(lib.encode(text[:i])) for i in range(len(text) + 1)]
        assert own.count(text) == own.prefixes(text)[-1]
    for n in (1, 15, 16, 17, 40, 100):
        for tail in ("", "a", "日b", "<|x"):
            assert own.count(" " * n + tail) == len(lib.encode(" " * n + tail))


def test_token_counts(docs, none):
    lib = library()
    want = sorted(((i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t in awkward()), key=repr)
    assert table(token_counts.count_tokens(docs, MODEL), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(none, MODEL).count() == 0


def test_where_a_budget_ends():
    rng, own = random.Random(7), token_counts.PrefixCounter(MODEL)
    parts = ["the", "ing", " ", "  ", "\n", "日", ".", "</s>", "ß", "😀", "12", "Tionthe"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        counts = own.prefixes(text)
        for budget in (0, 1, 3, 8, 40):
            assert own.within(text, budget) == token_counts.chars_within(counts, budget)
    assert own.within(None, 5) == 0


def test_shared_prefixes_are_worked_out_once():
    class Asked(dict):
        n = 0

        def get(self, *key):
            Asked.n += 1
            return super().get(*key)

    lib, own = library(), token_counts.PrefixCounter(MODEL)
    own.own = Asked()
    words_ = ["thetioningsherwhatendthemore" + a + b for a in "abcdefghijklmnopqrst" for b in "aeiouy"]
    text = " ".join(words_)
    assert own.count(text) == len(lib.encode(text))
    assert Asked.n < len(text)  # one question a character, at least, if each word is read from its start


def test_token_pairs_stand_where_merging_keeps_them():
    rng, own = random.Random(3), token_counts.PrefixCounter(MODEL)
    tokens = [t for t in sorted(own.rank) if own.merge(t) == [t]]
    found = []
    for a, b in ((rng.choice(tokens), rng.choice(tokens)) for _ in range(4000)):
        found.append(own._apart(a, b))
        assert found[-1] == (own.merge(a + b) == [a, b]), (a, b)
    for t in rng.sample(tokens, 400):
        for i in range(1, len(t)):
            if own.merge(t[:i]) == [t[:i]] and own.merge(t[i:]) == [t[i:]]:
                found.append(own._apart(t[:i], t[i:]))
                assert found[-1] == (own.merge(t) == [t[:i], t[i:]]), (t, i)
    assert {True, False} == set(found)


@pytest.mark.parametrize("bounds", [{}, {"CACHE_WORDS": 5, "CACHE_CHARS": 3, "BLOCK_CHARS": 30}])
def test_counts_of_many_texts(monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(token_counts, k, v)
    rng, lib, own = random.Random(11), library(), token_counts.PrefixCounter(MODEL)
    parts = ["the", "ing", "Tionthe", " ", "  ", "\n", " \n", "é", "日", "日本語", ".", "!!", "</s>", "a", "ß", "\t", "😀", "12", "▁", "▁▁", "\x00"]
    texts = [None, "", " ", "   ", "▁", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(300)), "日本語" * 90]
    for _ in range(2):
        assert own.counts(texts) == [len(lib.encode(t or "")) for t in texts]
    for t in texts:
        assert [own.within(t, n) for n in (0, 1, 4, 9)] == [token_counts.chars_within(own.prefixes(t), n) for n in (0, 1, 4, 9)]
    assert own.counts([]) == [] and not any(len(w) > token_counts.CACHE_CHARS for w in own.words)


def test_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 300)
    lib, own, learnt, most = library(), token_counts.PrefixCounter(MODEL), [], 0
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda segments: (learnt.extend(segments), learn(segments)))
    for i in range(30):
        text = "evergreen " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{'aeiou'[j // 26]}{'xyz'[i // 13]}" for j in range(100))
        assert own.counts([text, "evergreen"]) == [len(lib.encode(text)), len(lib.encode("evergreen"))]
        most = max(most, len(own.words) + len(own.words.old))
    assert learnt.count("▁evergreen") == 1 and len(learnt) > 1000 and most < 600


def test_truncation_needs_no_encoding(docs):
    lib = library()
    texts = dict(awkward())
    got = token_counts.truncate(token_counts.prefix_table(docs.where("doc_id in (6, 15)"), MODEL), 9).collect()
    for r in got:
        t, n = texts[r["doc_id"]], r["n_chars_kept"]
        assert len(lib.encode(t[:n])) == r["n_tokens_kept"] <= 9
        assert all(len(lib.encode(t[:k])) > 9 for k in range(n + 1, min(len(t), n + 6)))


# -- 2: exact dedup ----------------------------------------------------------------------


@pytest.mark.parametrize("words_", [1 << 10, common.MAX_FILTER_WORDS])
def test_exact_dedup(docs, none, words_):
    norm = [(i, (t or "").translate(LOWER)) for i, t in awkward()]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = []
    for i, t in norm:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, max_filter_words=words_)
    assert table(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_many_ranges_change_nothing(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), (F.col("id") % 20000).cast("string").alias("text"))
    got = exact_dedup.exact_dedup(df, max_filter_words=1024)
    assert got.where("kept").count() == 20000 and got.where("group_size = 2").count() == 20000


def test_few_singles_are_shuffled_at_any_size(spark):
    """Ten times what one filter takes: 50,000 singles, 10,000 pairs, and a text that a third of all rows share."""
    n = 105_000
    text = F.when(F.col("id") < 50_000, F.col("id")).when(F.col("id") < 70_000, F.col("id") % 10_000 + 50_000).otherwise(F.lit(-1))
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("_id"), F.unhex(F.sha2(text.cast("string").cast("binary"), 256)).alias("_digest"))
    digests, ranges = exact_dedup.digest_ranges(rows, n, max_filter_words=1024, block_digests=4096)
    assert ranges == 13
    sent = exact_dedup.set_again(digests)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan
    tested = exact_dedup.maybe_repeated(digests, ranges, max_filter_words=1024)
    assert tested.count() == n
    assert tested.where("_id >= 50000 and not _maybe").isEmpty()
    assert tested.where("_id < 50000 and _maybe").count() < 0.05 * 50_000


def test_hot_groups_join_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = common.join_groups(rows, groups, "k", "n", 5000)
    assert got.count() == 5000 and got.where("k = 0 and top = 2999 and n = 3000").count() == 3000 and got.where("top is null").isEmpty()


# -- 3: span dedup -----------------------------------------------------------------------


def test_repeated_passages_go_but_for_the_first(spark, docs, none):
    rng = random.Random(8)
    passage = prose(rng, 90)
    rows = [(i, prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 40)) for i in (5, 2, 9)] + [(7, prose(rng, 200)), (11, prose(rng, 30) + " " + passage[:40])]
    rows.append((12, prose(rng, 20) + ".\n" + passage + "\n" + passage))
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    text = dict(rows)
    assert got[2]["text"] == text[2] and got[7]["text"] == text[7] and got[11]["text"] == text[11]
    middle = passage[100:-100]
    for i in (5, 9, 12):
        assert middle[:200] not in got[i]["text"] and got[i]["n_removed"] > 0
        data, kept, at = text[i].encode(), b"", 0
        for s in got[i]["removed_spans"]:
            kept, at = kept + data[at : s["start"]], s["end"]
        assert (kept + data[at:]).decode() == got[i]["text"]
        assert got[i]["text"].startswith(text[i].split("\n")[0][:30])
    odd = span_dedup.remove_repeats(docs)
    assert odd.count() == len(awkward())
    assert {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] in (1, 2, 4, 13)} == {1: "", 2: "", 4: "Word", 13: "x" * 50_000}
    assert span_dedup.remove_repeats(none).count() == 0


def plain_pieces(text):
    """Words of each piece, by the rules in plain words."""
    found = list(WORD.finditer(text))
    sentences, now = [], []
    for m, after in zip(found, [*found[1:], None]):
        now.append(m.group().translate(LOWER))
        if after is None or m.group()[-1] in ".!?" or re.search("[\n\r]", text[m.end() : after.start()]):
            sentences.append(now)
            now = []
    pieces = []
    for words_ in sentences:
        if len(words_) <= 12:
            pieces.append(words_)
            continue
        now = []
        for w in words_:
            now.append(w)
            ((_, (h,), _),) = words.WordHasher().documents(pa.array([w]))
            if int(h) % 4 == 0:
                pieces.append(now)
                now = []
        if now:
            pieces.append(now)
    return pieces


def test_repeats_against_plain_sentences(spark):
    """A piece is cut just when a later copy of a repeated run covers it."""
    rng = random.Random(4)
    pool = [prose(rng, rng.choice([3, 5, 8, 11, 30]), stops=False).capitalize() + rng.choice([". ", "!\n", "?  ", "\n", " "]) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    seen, want = {}, {}
    for i, t in rows:
        pieces, runs = plain_pieces(t), set()
        size = lambda a, z: sum(map(len, pieces[a:z]))  # noqa: B023, E731
        for k in range(len(pieces)):
            ahead = [z for z in range(k + 3, len(pieces) + 1) if size(k, z) >= 24]
            back = [a for a in range(k - 1) if size(a, k + 1) >= 24]
            runs |= {(k, ahead[0])} if ahead else set()
            runs |= {(back[-1], k + 1)} if back else set()
        cut = set()
        for a, z in sorted(runs):
            name = tuple(w for p in pieces[a:z] for w in p)
            if seen.setdefault(name, (i, a)) != (i, a):
                cut |= set(range(a, z))
        want[i] = len(pieces), len(cut)
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"]) for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and sum(c for _, c in want.values()) > 50


def test_a_repeated_passage_goes_to_its_last_piece(spark):
    rng = random.Random(31)
    passage = " ".join(prose(rng, 9, stops=False) + "." for _ in range(8))
    rows = [(i, prose(rng, 30) + ".\n" + passage + "\n" + prose(rng, 30)) for i in range(3)]
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 8 and not set(passage.split(". ")) & set(got[i]["text"].split(". ")) for i in (1, 2))


# -- 4: chat formatting -----------------------------------------------------------------


def test_escaping_is_exact_and_leaves_no_control_string():
    rng = random.Random(1)
    parts = [*chat_format.CONTROL, "\\", "<", "[", "|", ">", "/", "a", "\n", "<|im_", "start|>", "😀"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)


def test_chats_read_back(spark, none):
    said = [(1, 1, "assistant", "two\\"), (1, 0, "user", None), (1, None, "system", "</s>"), (2, 0, "assistant", ""), (2, 0, "assistant", "x"), (2, 1, None, "y"), (None, 0, "user", "z"), (3, 5, "assistant", "long " * 5000)]
    t = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    every = chat_format.contract_rows(t)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(every, RANKS), RANKS).collect()}
    rows = [*said, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        learnt = "".join(r[3] for r in mine if r[2] == "assistant")
        want = (len(mine), hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
        assert got[conv]["formatted_chars"] > sum(len(r[2]) + len(r[3]) for r in mine)
    one = chat_format.format_chats(every.where("conv_id = 2"), RANKS).first()
    codec = chat_format.ChatCodec(RANKS)
    assert all(one["ids"][i] == codec.turn for i in one["turn_at"]) and len(one["loss_spans"]) == 2
    assert chat_format.format_chats(t.limit(0), RANKS).count() == 0


# -- 5: scores ------------------------------------------------------------------------------


def naive_score(model, text):
    """A text's score word by word, with plain sums."""
    net, words_ = model.net, WORD.findall((text or "").translate(LOWER))
    ((_, hashes, _),) = words.WordHasher().documents(pa.array([" ".join(words_)]))
    gain = {r["word"]: np.log(r["n"]) for r in model.rare.collect()} | dict(zip(model.common[0].view(np.int64).tolist(), model.common[1]))
    known = {int(h): int(p) for h, p in zip(net.words, net.places)}
    places = [known.get(int(h), lm_score.FREQUENT + (int(h) >> 40) % lm_score.BUCKETS) for h in hashes]
    total = 0.0
    for i, place in enumerate(places):
        h = net.hidden.astype(float).copy()
        for row, d in enumerate([*range(-lm_score.WINDOW, 0), *range(1, lm_score.WINDOW + 1)]):
            near = places[i + d] if 0 <= i + d < len(places) else lm_score.PLACES
            h += net.near[row * (lm_score.PLACES + 1) + near]
        h = np.tanh(h)
        of, at = divmod(place, lm_score.SIZE)
        for z, j in ((h @ net.to_class + net.class_bias, of), (h @ net.to_place[of] + net.place_bias[of], at)):
            total += z[j] - z.max() - np.log(np.exp(z - z.max()).sum())
        if place >= lm_score.FREQUENT:
            total += gain.get(int(hashes[i].astype(np.int64)), 0.0) - np.log(model.uses[place - lm_score.FREQUENT])
    return total


def test_pseudo_likelihood(spark, docs, none):
    rng = random.Random(6)
    rows = [(i, " ".join(["red", "green", "blue", "black"] * rng.randint(10, 30))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = lm_score.train(df)
    score = lambda t: lm_score.score(spark.createDataFrame([(0, t)], "doc_id bigint, text string"), model).first()
    usual, odd = score("red green blue black " * 10), score("red red black green blue blue " * 7)
    assert usual["mean_log_likelihood"] > -0.7 and usual["mean_log_likelihood"] > odd["mean_log_likelihood"] + 1
    # every conditional is a distribution over the places
    net, n = model.net, lm_score.PLACES
    context = np.random.default_rng(1).integers(0, n, (2 * lm_score.WINDOW, 1)) + np.arange(2 * lm_score.WINDOW)[:, None] * (n + 1)
    assert np.exp(net.log_probability(context.repeat(n, 1), np.arange(n))).sum() == pytest.approx(1, abs=1e-4)
    got = {r["doc_id"]: r for r in lm_score.score(docs, model).collect()}
    assert (got[1]["n_tokens"], got[1]["log_likelihood"], got[1]["mean_log_likelihood"]) == (0, 0.0, None) and got[14]["n_tokens"] == 20_000
    assert lm_score.score(none, lm_score.train(none)).count() == 0
    # a column of the same name does not get in
    clash = df.limit(3).withColumn("log_likelihood", F.lit(7.0))
    assert lm_score.score(clash, model).where("log_likelihood = 7").isEmpty()


def test_scores_against_plain_sums_and_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COMMON", 500)
    rng = random.Random(14)
    # more distinct words than places, some of them rare but repeated
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(500, rows[7][1]), (None, rows[8][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    models = [lm_score.train(df.repartition(n), shard_docs=40) for n in (3, 7)]
    assert models[0].n_rare > 50 and np.allclose(models[0].net.flat(), models[1].net.flat(), atol=1e-6)
    scored = [sorted((repr(r["doc_id"]), r["n_tokens"], r["log_likelihood"]) for r in lm_score.score(df.repartition(n), m).collect()) for n, m in zip((5, 2), models)]
    assert [x[:2] for x in scored[0]] == [x[:2] for x in scored[1]]
    assert np.allclose([x[2] for x in scored[0]], [x[2] for x in scored[1]], atol=1e-2)
    got = {x[0]: x[2] for x in scored[0]}
    for i in (*range(10), 500):
        text = dict(rows)[i]
        assert got[repr(i)] == pytest.approx(naive_score(models[0], text), abs=0.05), i
    assert got["500"] == pytest.approx(got["7"], abs=1e-3) and got["None"] == pytest.approx(got["8"], abs=1e-3)


def test_every_position_trains_the_network(spark):
    # of a text of one word and of one of two, each place is an example in one of the rounds
    for text in ("alone", "two words"):
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        assert lm_score.train(df).net.hidden.any(), text
    seen = [[i for i in range(9) if i % lm_score.ROUNDS == r] for r in range(lm_score.ROUNDS)]
    assert sorted(sum(seen, [])) == list(range(9))


# -- 6: near duplicates -----------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), find(i), find(i) == i) for i in ids), key=repr)


def near_rows():
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = WORD.findall(prose(rng, rng.choice([8, 40, 120])))
        for _ in range(rng.choice([1, 3, 40])):
            w = [x if rng.random() > rng.choice([0, 0.02, 0.05, 0.09]) else rng.choice(SYLLABLES) for x in base]
            rows.append((rng.randint(-50, 10**6), " ".join(w)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize(("size", "block", "head"), [(2, 500_000, 100_000), (2, 900, 300), (5, 500_000, 2_000)])
def test_near_duplicates(spark, size, block, head):
    rows = near_rows()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size, 80, block_shingles=block, head_shingles=head)
    assert table(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, size, 80)


def test_near_duplicates_of_awkward_rows(docs, none):
    got = near_dedup.near_duplicates(docs, 2, 80)
    rows = [r for r in awkward() if r[0] is not None]
    want = brute_components(dict(rows).items(), 2, 80)
    want.append(next(r for r in want if r[0] == 9))
    have = table(got.where("doc_id is not null"), "doc_id", "n_shingles", "component_id", "kept")
    assert have == sorted(want, key=repr)
    lone = got.where("doc_id is null").first()
    assert lone["component_id"] is None and lone["kept"]
    assert near_dedup.near_duplicates(none, 2, 80).count() == 0


def test_word_hashes_follow_the_word_rule():
    import pyarrow as pa

    texts = [t or "" for _, t in awkward()] + ["a  B\tc", "a", "", "A b\x0bC\r\n"]
    seen = {}
    for at, w, ends in words.WordHasher().documents(pa.array(texts)):
        for i, part in enumerate(np.split(w, ends[:-1])):
            plain = WORD.findall(texts[at + i].translate(LOWER))
            assert len(part) == len(plain)
            for h, p in zip(part.tolist(), plain):
                assert seen.setdefault(h, p) == p
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    got = dict(table(common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "t"), "id", "component"))
    root = list(range(500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


# -- 7: mixing ---------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_mixing_against_sql(spark, tmp_path, bucket_rows):
    rng = random.Random(7)
    sizes = {"a": 400, "b": 5, "c": 60, "É": 30, None: 90, "z": 0}
    rows = [(i, prose(rng, rng.randint(0, 30)) if s != "z" else None, s) for i, s in enumerate(x for x, n in sizes.items() for _ in range(max(n, 3)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    res = con.execute(mixing.SQL)
    names = [d[0] for d in res.description]
    want = sorted((tuple(r[names.index(c)] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in res.fetchall()), key=repr)
    got = mixing.mix(df, bucket_rows=bucket_rows)
    assert table(got, "doc_id", "size", "source_size", "target", "taken") == want
    by_source = got.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("m"), F.first("source_size").alias("s")).collect()
    assert sum(r["t"] for r in by_source) == pytest.approx(sum(r["s"] for r in by_source))
    for r in by_source:
        assert abs(r["n"] - r["t"]) <= 2 * r["m"] and r["t"] <= 3 * r["s"]


def test_mixing_of_awkward_rows(docs, none):
    got = mixing.mix(docs)
    assert got.count() == len(awkward())
    assert [r["size"] for r in got.where("doc_id in (1, 2, 3)").collect()] == [0, 0, 0]
    assert got.where("taken > 3 * size or taken < 0").isEmpty()
    assert mixing.mix(none).count() == 0
    empty = mixing.mix(docs.where("doc_id in (1, 2)"))
    assert {(r["target"], r["taken"]) for r in empty.collect()} == {(0.0, 0)}


# -- 8: toxicity ---------------------------------------------------------------------------


def toxic_rows(n=900):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        t, bad = prose(rng, rng.randint(20, 120)), rng.random() < 0.2
        if bad:
            w = t.split(" ")
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zlug", "Grubwort", "vomple"]))
            t = " ".join(w)
        rows.append((i, t, int(bad)))
    return rows


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        terms = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        w = rng.random(len(terms)) + 0.1
        rows.append((terms, w / np.sqrt((w * w).sum())))
    laid_out = lambda rs: (np.cumsum([0] + [len(t) for t, _ in rs]), np.concatenate([t for t, _ in rs]), np.concatenate([w for _, w in rs]))
    index = toxicity.BlockMaxIndex(*laid_out(rows), 40)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for (t, w), (_, got) in zip(rows[:150], index.nearest(*laid_out(rows[:150]), 15)):
        q = np.zeros(40)
        q[t] = w
        want = np.sort(dense @ q)[::-1][:15]
        want = want[want > 0]
        assert np.allclose(got, want, atol=2e-6)


def test_toxicity_on_held_out_rows(spark, docs, none):
    rows = toxic_rows()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, toxicity.learnable(labels))
    truth = {r[0]: r[2] for r in rows}
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    hits = sum(got[i]["predicted"] == truth[i] for i in held)
    assert len(held) > 200 and hits >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert any(got[i]["evidence"] and truth[got[i]["evidence"][0]] == 1 for i in held if truth[i])
    odd = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert odd[1]["score"] == odd[2]["score"] < 0.3 and odd[14]["predicted"] == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(df, toxicity.learnable(labels.limit(0))) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    tame = toxicity.fit(df, toxicity.learnable(labels.where("toxic = 0")))
    assert toxicity.score(df, tame).where("predicted = 1").isEmpty()


def test_toxicity_learns_from_few_labels_and_from_all_terms(spark):
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.randint(20, 60)) + (f" {rng.choice(['zlug', 'vomple'])} grubwort" if i % 9 == 0 else ""), int(i % 9 == 0)) for i in range(54)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    got = toxicity.score(spark.createDataFrame([(100, prose(rng, 40) + " grubwort zlug"), (101, prose(rng, 40))], "doc_id bigint, text string"), model)
    got = {r["doc_id"]: r for r in got.collect()}
    assert got[100]["score"] > 0.5 > got[101]["score"]
    # a clean text has neighbours too
    assert len(got[101]["evidence"]) == 3


def test_votes_and_calibration_against_plain_definitions():
    rng = np.random.default_rng(8)
    model = toxicity.ToxicityModel(0.3, 0.05)
    model.toxic = rng.integers(0, 2, 50)
    entries, cosines = np.array([4, 9, 30]), np.array([0.9, 0.5, 0.5])
    w = [1 / (0.02 + 1 - c) for c in cosines]
    assert model.vote(entries, cosines) == pytest.approx(sum(a * model.toxic[e] for a, e in zip(w, entries)) / sum(w))
    assert model.vote(entries[:0], cosines[:0]) == 0.3 and model.score(entries[:0], cosines[:0]) == 0.05
    votes = np.round(rng.random(200), 2)
    labels = (rng.random(200) < votes).astype(int)
    model.calibrate(votes, labels)
    # isotonic regression as the greatest of least means
    values = np.unique(votes)
    mean = lambda a, z: labels[(votes >= values[a]) & (votes <= values[z])].mean()
    fit = [max(min(mean(a, z) for z in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    rates = []
    for x in sorted({round(f, 9) for f in fit}):
        inside = [v for v, f in zip(values, fit) if round(f, 9) == x]
        here = labels[(votes >= inside[0]) & (votes <= inside[-1])]
        rates += [(v, (here.sum() + 0.3) / (len(here) + 1)) for v in inside]
    best = 0.0
    for v, r in rates:
        best = max(best, r)
        assert np.interp(v, *model.steps) == pytest.approx(best, abs=1e-9)


def test_toxicity_scores_against_all_examples(spark):
    """The whole model against dense vectors of terms counted in plain Python."""
    rows = toxic_rows(160)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    letters = re.compile("[a-z]+")

    def terms(t):
        found = letters.findall(t.lower())
        return collections.Counter([("w", w) for w in found] + [("b", w[:6]) for w in found if len(w) >= 6]), len(found)

    counts = {i: terms(t) for i, t, _ in rows}
    truth, vocab = {i: y for i, _, y in rows}, sorted({x for c, _ in counts.values() for x in c})
    n = collections.Counter(truth.values())
    mean_words = np.mean([m for _, m in counts.values()])
    weight = {}
    for x in vocab:
        rate = {i: c[x] / (m + toxicity.SHORT) for i, (c, m) in counts.items()}
        means = [sum(r for i, r in rate.items() if truth[i] == y) / n[y] for y in (0, 1)]
        var = np.mean([r * r for r in rate.values()]) - np.mean(list(rate.values())) ** 2 + (1 / (mean_words + toxicity.SHORT)) ** 2 / len(rows)
        apart = abs(means[1] - means[0]) / np.sqrt(var * (1 / n[0] + 1 / n[1]))
        weight[x] = np.log1p(len(rows) / (1 + sum(x in c for c, _ in counts.values()))) * (toxicity.FLOOR + apart)
    at = {x: k for k, x in enumerate(vocab)}
    dense = np.zeros((len(rows), len(vocab)))
    for row, (i, _, _) in enumerate(rows):
        for x, f in counts[i][0].items():
            dense[row, at[x]] = f * weight[x]
    dense /= np.sqrt((dense**2).sum(axis=1, keepdims=True))
    cosine, y = dense @ dense.T, np.array([r[2] for r in rows])
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    for row, (i, _, _) in enumerate(rows):
        near = np.argsort(-np.round(cosine[row], 6), kind="stable")[: toxicity.NEIGHBOURS]
        w = 1 / (0.02 + np.maximum(0, 1 - cosine[row][near]))
        vote = (w * y[near]).sum() / w.sum()
        assert got[i]["score"] == pytest.approx(float(np.interp(vote, *model.steps)), abs=0.02), i
        assert got[i]["evidence"][0] == i
    # without its own example a row is scored by all others
    got = {r["doc_id"]: r for r in toxicity.score(df, model, leave_out=True).collect()}
    for row, (i, _, _) in enumerate(rows):
        near = [j for j in np.argsort(-np.round(cosine[row], 6), kind="stable") if j != row][: toxicity.NEIGHBOURS]
        w = 1 / (0.02 + np.maximum(0, 1 - cosine[row][near]))
        assert got[i]["score"] == pytest.approx(float(np.interp((w * y[near]).sum() / w.sum(), *model.steps)), abs=0.02), i
        assert i not in got[i]["evidence"]


# -- 9: decontamination --------------------------------------------------------------------


def test_leaks_are_found_and_nothing_else(spark, docs, none):
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randint(10, 70))) for i in range(80)] + [(90, None), (91, ""), (92, "the an"), (93, prose(rng, 300))]
    rows, want = [], set()
    for d in range(120):
        text = prose(rng, rng.randint(0, 400))
        if d % 2:
            i = rng.choice([*range(80), 93])
            leak = dict(items)[i]
            text = text + (" " if text else "") + (leak.upper() if d % 4 == 1 else "\n".join(leak.split(" "))) + " " + prose(rng, rng.randint(0, 60))
            want.add((d, i))
        rows.append((d, text))
    # one word changed in a long passage leaves a similarity of 0.8 or more
    w = dict(items)[93].split(" ")
    w[150] = "changed"
    rows.append((500, prose(rng, 50) + " " + " ".join(w)))
    want.add((500, 93))
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (decontaminate.BLOCK_ITEMS, 30):
        got = decontaminate.find_leaks(df, bench, block_items=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        assert r["similarity"] >= 0.8
        if r["doc_id"] != 500:
            w = WORD.findall(dict(rows)[r["doc_id"]].lower())
            n = WORD.findall(dict(items)[r["item_id"]].lower())
            assert w[r["first_word"] : r["first_word"] + len(n)] == n
    assert decontaminate.find_leaks(docs, bench).count() == 0
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_no_fingerprint_within_the_radius_is_missed():
    rng = random.Random(2)
    b = decontaminate.Benchmark([1, 2], [prose(rng, 40), prose(rng, 41)], 5, 8, 0.8)
    c = b.classes[0]
    bits = np.random.default_rng(3)
    for k, p in enumerate(c.prints):
        for _ in range(500):
            flips = bits.choice(64, bits.integers(0, decontaminate.RADIUS + 1), replace=False)
            near = np.array([int(p) ^ int(sum(1 << int(f) for f in flips))], np.uint64).view(np.uint16)
            hit = c.tables[0][0][near[0]] | c.tables[0][1][near[1]] | c.tables[0][2][near[2]] | c.tables[0][3][near[3]]
            assert hit >> k & 1


def test_near_copies_are_found_wherever_they_start():
    rng = random.Random(31)
    items = [prose(rng, n) for n in range(12, 72)]
    b = decontaminate.Benchmark(list(range(len(items))), items, 5, 8, 0.8)
    hasher = words.WordHasher()

    def hashed(text):
        return next(iter(hasher.documents(pa.array([text]))))[1:]

    def exact(item, found):
        mine = dict(zip(*b.sets[item]))
        n, best = min(len(b.words[item]), len(found)), (0.0, 0)
        for at in range(len(found) - n + 1):
            theirs = dict(zip(*b.weighted(found[at : at + n])))
            common = sum(w for s, w in mine.items() if s in theirs)
            best = max(best, (common / (sum(mine.values()) + sum(theirs.values()) - common), -at))
        return best[0], -best[1]

    leaks = 0
    for i, text in enumerate(items):
        for changed in (0, 0, 1, 1, 1, 2, 2):
            w = text.split(" ")
            for _ in range(changed):
                w[rng.randrange(len(w))] = "changed"
            found, ends = hashed(" ".join([prose(rng, rng.randint(1, 90)), *w, prose(rng, rng.randint(1, 40))]))
            got = {r[1]: r[2:] for r in b.search(found, ends)}
            score, first = exact(i, found)
            assert (i in got) == (score >= 0.8) and set(got) <= {i}
            if got:
                leaks += 1
                assert got[i] == (pytest.approx(score), first)
    assert leaks > 200


def test_documents_shorter_than_an_item_are_searched():
    rng = random.Random(32)
    items = [prose(rng, n) for n in range(15, 60)]
    b = decontaminate.Benchmark(list(range(len(items))), items, 5, 8, 0.8)
    cut = [" ".join(t.split(" ")[:-1]) for t in items]
    ((_, found, ends),) = words.WordHasher().documents(pa.array(cut + [" ".join(t.split(" ")[:8]) for t in items] + ["", "the"]))
    got = [(r[0], r[1], r[3]) for r in b.search(found, ends)]
    assert sorted(got) == [(i, i, 0) for i in range(len(items))]


# -- 10: languages ----------------------------------------------------------------------


def test_gram_counts_do_not_depend_on_seams(monkeypatch):
    rng, grams = random.Random(3), language_id.Grams()
    texts = [prose(rng, n).encode() for n in (0, 1, 40, 400)] + [b"  a  b ", b"..", b" " * 30, b"x" * 70, ("é " * 50).encode()]
    whole = [grams.count(np.frombuffer(t, np.uint8)) for t in texts]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        assert all((grams.count(np.frombuffer(t, np.uint8)) == w).all() for t, w in zip(texts, whole))
    # counts weigh on beyond any bound
    idf = np.ones(2, np.float32)
    assert language_id.weigh(np.array([[5_000, 1]]), idf)[0, 0] < language_id.weigh(np.array([[500_000, 1]]), idf)[0, 0]


def test_languages(spark, docs, none):
    rng = random.Random(30)
    kinds = {"aa": ["ki", "lo", "mu", "zen"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["ção", "não", "lhe", "que"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(list(kinds) * 120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df.where(queries.fold("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    odd = language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "日本"), (5, "qqqq xxxx wwww")], "doc_id bigint, text string"), model, reject=True)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in odd.collect()}
    assert [pred[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and pred[5][0] == "und"
    assert language_id.identify(docs, model).count() == len(awkward()) and language_id.identify(none, model).count() == 0
    assert language_id.fit(none) is None
    # by hand: grams of blanks and letters, their weights, and the nearest of all centroids
    for i, t, _ in rows[:12]:
        x = [32, *[c if chr(c).isalpha() or c >= 128 else 32 for c in t.lower().encode()], 32]
        x = [c for j, c in enumerate(x) if j == 0 or c != 32 or x[j - 1] != 32]
        counts, mask = np.zeros(language_id.BUCKETS), (1 << 32) - 1
        for j in range(len(x) - 1):
            two = (x[j] * 0x9E3779B1 + x[j + 1] * 0x85EBCA6B) & mask
            for g in [two] + ([(two * 0xC2B2AE35 + x[j + 2] * 0x27D4EB2F) & mask] if j + 2 < len(x) else []):
                counts[((g ^ (g >> 15)) * 0x2C1B3C6D & mask) >> 19] += 1
        v = np.log1p(counts) * model.idf
        close = model.centroids @ (v / np.sqrt((v * v).sum()))
        best = [max(close[model.of == k]) for k in range(len(model.languages))]
        soft = np.exp((np.array(best) - max(best)) / language_id.TEMPERATURE)
        assert got[i]["lang_pred"] == model.languages[int(np.argmax(best))] and got[i]["score"] == pytest.approx(1 / soft.sum(), abs=1e-3)
    # a column that is called as a result does not get in
    clash = df.withColumns({"lang_pred": F.lit("zz"), "score": F.lit(9.0)})
    assert language_id.identify(clash, model).where("lang_pred = 'zz' or score > 1").isEmpty()
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}


# -- the pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(40)
    toxic = toxic_rows(400)
    leak = prose(rng, 40)
    rows = [(i, t, "en", f"s{i % 3}") for i, t, _ in toxic]
    clean = [i for i, _, y in toxic if not y]
    base = prose(rng, 150)
    rows += [(1000, base, "en", "s0"), (1001, base.upper(), "en", "s1"), (1002, base + " end", "en", "s2"), (1003, prose(rng, 60) + " " + leak, "en", "s0"), (1004, None, None, None), (1005, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, step in corpus_pipeline.STAGES:
        now = step(spark, now, d)
        out = f"{d}/out-{name}"
        now.write.parquet(out)
        now = spark.read.parquet(out)
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
        if name != "mixing":
            assert now.columns == docs.columns
    after_toxic, after_exact, after_near, after_leaks, mixed = kept
    assert len({i for i, _, y in toxic if y} & after_toxic) <= 4 and set(clean) <= after_toxic
    assert after_toxic - after_exact == {1000, 1004} and after_exact - after_near == {1002}
    assert after_near - after_leaks == {1003} and mixed <= after_leaks and len(mixed) > 100
    assert {"size", "taken"} <= set(now.columns)
    assert corpus_pipeline.run(spark, d).count() == len(mixed)
    shutil.rmtree(d, ignore_errors=True)


def test_pipeline_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng, d = random.Random(44), str(tmp_path)
    base, leak, other = prose(rng, 120), prose(rng, 40), prose(rng, 90)
    rows = [(None, other), (None, base + " tail"), (5, base), (5, prose(rng, 70)), (5, prose(rng, 50) + " " + leak), (6, base.upper()), (None, prose(rng, 30) + " " + leak), (7, None), (8, ""), (9, "short"), (9, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint"), "_row": F.lit(3), "size": F.lit("x")})
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs.drop("_row").write.parquet(f"{d}/documents.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        now = step(spark, now, d)
        seen.append(sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr))
    toxic, exact, near, leaks, mixed = seen
    assert toxic == sorted(rows, key=repr)
    # base in capitals is a copy with a larger id; of empty texts and of rows alike one stays
    assert sorted(exact, key=repr) == sorted([r for r in rows if r not in ((5, base), (7, None), (9, "short"))] + [(9, "short")], key=repr)
    # null comes before all ids, so the near copy without one stays
    assert [r for r in exact if r not in near] == [(6, base.upper())]
    assert sorted(leaks, key=repr) == sorted([r for r in near if leak not in (r[1] or "")], key=repr)
    assert set(mixed) <= set(leaks) and (None, other) in mixed and (8, "") not in mixed
    assert now.columns == [c for c in docs.columns if c not in ("_row", "size")] + ["size", "taken"] and now.schema["size"].dataType.simpleString() == "bigint"
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, d)
        assert empty.isEmpty()
    shutil.rmtree(d, ignore_errors=True)


def test_queries_are_registered():
    assert sorted(queries.QUERIES, key=lambda k: int(k[2:].split("_")[0])) == [k for n in range(1, 11) for k in queries.QUERIES if k.startswith(f"op{n}_")]
    assert set(queries.SQL) <= set(queries.QUERIES) and os.path.exists(MODEL)
