"""Token counts by dynamic programming over prefixes.

For a BPE vocabulary the tokens of a prefix ending at ``i`` are those of a shorter
prefix plus one last token, and that token is the only one which (a) ends at ``i``
and (b) stands unmerged beside the last token of the shorter prefix. So one pass
over a text yields the exact token count of every prefix: ``count[i] =
count[i - len(last)] + 1``. Budget questions ("how much fits in k tokens?") and
truncations are lookups in that table.

No piece of the vocabulary has its word mark behind another character or joins letters
to other characters, so such stretches are independent: the pass runs once per distinct
stretch of a task and counts add up. Stretches new to a task are taken in order, so that
the pass goes on from the prefix that a stretch shares with the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from heaploom.llm.common import bounded_batches

MARK = "▁"
#: Words of a text with what follows them up to the next mark; no stretch reaches from one into another.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct words and stretches remembered by one task, and the characters of the longest of them.
CACHE_WORDS = 1_000_000
CACHE_CHARS = 100
#: Characters of texts whose new words are learnt together.
BLOCK_CHARS = 4_000_000


class _Known(dict[str, int]):
    """Tokens of words. One that is not known counts nothing and is noted in ``new``.

    When half the words that may be remembered are here, they become ``old``; of those, words
    that are used again come back and the others are forgotten the next time.
    """

    def __init__(self) -> None:
        self.new: list[str] = []
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            self.new.append(word)
            return 0
        self[word] = n
        return n

    def age(self) -> None:
        if len(self) >= CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()

    def find(self, word: str) -> int | None:
        n = self.get(word)
        return self.old.get(word) if n is None else n


class PrefixCounter:
    """Exact prefix token counts of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity":
            raise ValueError("the model must be BPE with the identity normalizer")
        self.rank = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces must not span words")
        self.longest = max(map(len, self.rank))
        self.segment = self._pattern()
        self.suffixes = {p[i:] for p in self.rank for i in range(len(p))}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.own: dict[str, int] = {}
        self.traces: dict[str, list[tuple[float, str, str]]] = {}
        self.words = _Known()

    def _pattern(self) -> re.Pattern[str]:
        """Stretches no piece reaches across: marks, then letters with what pieces join to letters, or other characters."""
        pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1) if p[i] != MARK}
        mixed = {c for p in pairs if p[0].isalpha() != p[1].isalpha() for c in p if not c.isalpha()}
        while more := {c for p in pairs if (p[0] in mixed) != (p[1] in mixed) for c in p if c not in mixed and not c.isalpha()}:
            mixed |= more
        letter = "[^\\W\\d_]" if not mixed else f"(?:[^\\W\\d_]|[{re.escape(''.join(sorted(mixed)))}])"
        other = rf"[^{MARK}\n]" if not mixed else rf"[^{MARK}\n{re.escape(''.join(sorted(mixed)))}]"
        return re.compile(rf"{MARK}*{letter}+|{MARK}*(?:(?![^\W\d_]){other})+|\n|{MARK}+")

    def _atom(self, ch: str) -> int:
        """Tokens of a character that no merge takes: itself, or its bytes."""
        return 1 if ch in self.rank else len(ch.encode("utf-8", "replace"))

    def merge(self, word: str) -> list[str]:
        """The definition: merge the best-scored adjacent pair, leftmost first, until none is left."""
        return self._merges(word)[0]

    def _merges(self, word: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Also each merge's score, with the first and the last part after it."""
        parts, trace = list(word), []
        while len(parts) > 1:
            best = max(((self.rank.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == float("-inf"):
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            trace.append((best[0], parts[0], parts[-1]))
        return parts, trace

    def _trace(self, t: str) -> list[tuple[float, str, str]]:
        """The merges of a token, and an end."""
        found = self.traces.get(t)
        if found is None:
            found = self.traces[t] = [*self._merges(t)[1], (float("-inf"), t, t)]
        return found

    def _apart(self, a: str, b: str) -> bool:
        """``merge(a + b) == [a, b]``: the merges of two tokens, best first, and none between them before both are whole."""
        left, right, i, j, end, start = self._trace(a), self._trace(b), 0, 0, a[-1], b[0]
        while True:
            x, y, across = left[i][0], right[j][0], self.rank.get(end + start, float("-inf"))
            if x >= y and x >= across and i < len(left) - 1:
                end, i = left[i][2], i + 1
            elif across >= y and across > float("-inf"):
                return False
            elif j < len(right) - 1:
                start, j = right[j][1], j + 1
            else:
                return True

    def _stands(self, a: str, b: str) -> bool:
        known = self.pairs.get(a)
        if known is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            known = self.pairs[a] = {}
        found = known.get(b)
        if found is None:
            found = known[b] = self._apart(a, b)
        return found

    def _token(self, t: str) -> int:
        """Tokens of a character, 1 for a longer token, 0 for what is none but may end one."""
        found = self.own.get(t)
        if found is None:
            if len(t) > 1 and t not in self.suffixes:
                raise AssertionError(f"no token ends with {t!r}")
            found = self.own[t] = self._atom(t) if len(t) == 1 else int(t in self.rank and self.merge(t) == [t])
        return found

    def word_prefixes(self, word: str) -> list[int]:
        """Token count of every prefix of a stretch (its spaces written as marks)."""
        spaces = len(word) - len(word.lstrip(MARK))
        if spaces < 2:
            return self._pass(word, [0], [""])[0]
        # Marks have one score, so among themselves the leftmost pair merges and their counts come
        # from the length of the run; its last mark may instead join what follows it.
        runs = self._runs(spaces)
        count, last = self._pass(word[spaces - 1 :], [0], [""])
        alone = [False, True]  # whether the first token of a prefix is a mark alone
        for i in range(2, len(last)):
            alone.append(alone[i - len(last[i])])
        return runs + [runs[spaces] + n - 1 if a else runs[spaces - 1] + n for n, a in zip(count[2:], alone[2:])]

    def _pass(self, word: str, count: list[int], last: list[str]) -> tuple[list[int], list[str]]:
        """The dynamic program: goes on, in place, from the counts and last tokens of a word's first prefixes."""
        own, pairs, none = self.own, self.pairs, {}
        for i in range(len(count), len(word) + 1):
            at = i
            while at:
                at -= 1
                t = word[at:i]
                size = own.get(t)
                if size is None:
                    size = self._token(t)
                if not size:
                    continue
                if at:
                    stands = pairs.get(last[at], none).get(t)
                    if stands is None:
                        stands = self._stands(last[at], t)
                    if not stands:
                        continue
                count.append(count[at] + size)
                last.append(t)
                break
            else:
                raise AssertionError(f"no last token at {i} of {word!r}")
        return count, last

    def _learn(self, segments: set[str]) -> None:
        """Remembers the tokens of stretches; a prefix that neighbours share is worked out once."""
        before, count, last = "", [0], [""]
        for s in sorted(segments):
            if s.startswith(MARK * 2):
                self.words[s] = self.word_prefixes(s)[-1]
                continue
            n = 1
            for a, b in zip(before, s):
                if a != b:
                    break
                n += 1
            del count[n:], last[n:]
            self.words[s] = self._pass(s, count, last)[0][-1]
            before = s

    def _runs(self, n: int) -> list[int]:
        top = max((len(p) for p in self.rank if not p.strip(MARK)), default=1)
        out = []
        for k in range(n + 1):
            out.append(len(self.merge(MARK * k)) if k <= 2 * top else out[k - top] + 1)
        return out

    def segments(self, text: str) -> list[str]:
        """The text as the model sees it: a mark in front, marks for spaces; cut into independent stretches."""
        return self.segment.findall(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty."""
        return self.counts([text])[0]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts; null counts as empty."""
        out, start, chars = [], 0, 0
        for end, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars >= BLOCK_CHARS or end == len(texts):
                out += self._block(texts[start:end])
                start, chars = end, 0
        return out

    def _block(self, texts: list[str | None]) -> list[int]:
        known = self.words
        known.age()
        out, new = [], []
        for text in texts:
            out.append(sum(map(known.__getitem__, WORD.findall(MARK + text.replace(" ", MARK)))) if text else 0)
            new.append(known.new)
            known.new = []
        words = set().union(*new)
        cut = {w: self.segment.findall(w) for w in words}
        segments = set().union(*cut.values()).difference(known).difference(known.old)
        self._learn(segments)
        known.update((w, sum(map(known.__getitem__, s))) for w, s in cut.items() if len(s) > 1)
        out = [n + sum(map(known.__getitem__, w)) for n, w in zip(out, new)]
        for w in words | segments:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    def _whole(self, segment: str) -> int:
        n = self.words.find(segment)
        return self.word_prefixes(segment)[-1] if n is None else n

    def within(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix that encodes to ``budget`` tokens at most: only the stretch that holds its end is looked at by prefixes."""
        base, best, known = 0, 0, self.words
        for m in WORD.finditer(MARK + text.replace(" ", MARK)) if text else ():
            n = known.get(m[0])
            if n is None:
                n = known.old.get(m[0])
            if n is not None and base + n <= budget:
                base, best = base + n, m.end() - 1
                continue
            at = m.start() - 1
            for s in self.segment.findall(m[0]):
                if base > budget:
                    return best
                n = self._whole(s)
                if base + n <= budget:
                    best = at + len(s)
                else:
                    best = max([best, *(at + j for j, c in enumerate(self.word_prefixes(s)) if j and base + c <= budget)])
                at, base = at + len(s), base + n
        return best

    def prefixes(self, text: str | None) -> list[int]:
        """``out[i]``: tokens of ``text[:i]`` encoded on its own, for every ``i``."""
        out, base = [0], 0
        for s in self.segments(text or ""):
            counts = self.word_prefixes(s)
            out += [base + c for c in counts[1:]]
            base += counts[-1]
        return [0, *out[2:]]


def chars_within(counts: list[int], budget: int) -> int:
    """Characters of the longest prefix that encodes to ``budget`` tokens at most."""
    return max(i for i, c in enumerate(counts) if c <= budget)


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit, n_chars_within.

    ``n_chars_within`` are the characters of the longest prefix that encodes to ``limit``
    tokens at most: where to cut, without encoding again.

    Null texts count as empty, so they have 0 bytes and 0 tokens. Repeated keys, texts
    of any length and tables without rows need nothing special; other columns are
    ignored, whatever their names. No shuffle: each task reads its own texts once.
    """
    bounded_batches(docs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model_file)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x.encode()) for x in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                    pa.array([len(t) if c <= limit else counter.within(t, limit) for t, c in zip(texts, n)], pa.int64()),
                ],
                names=[key, "n_bytes", "n_tokens", "over_limit", "n_chars_within"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(counted, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chars_within bigint")


def prefix_table(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored table: per document ``steps``, a 16-bit number per character, whose
    running sum is the token count of each prefix. See :func:`truncate` for its use."""
    bounded_batches(docs)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counter = PrefixCounter(model_file)
        for b in batches:
            rows = [np.diff(np.array(counter.prefixes(x), np.int64)).astype(np.int16).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=[key, "steps"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tabled, f"`{key}` {kind}, steps binary")


def truncate(table: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """Per document of a :func:`prefix_table`: the characters that fit in ``budget`` tokens, and the tokens they take."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            kept = []
            for x in b.column(1).to_pylist():
                c = np.concatenate([[0], np.cumsum(np.frombuffer(x, np.int16).astype(np.int64))])
                i = int(np.flatnonzero(c <= budget)[-1])
                kept.append((i, int(c[i])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=[key, "n_chars_kept", "n_tokens_kept"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, "steps").mapInArrow(cut, f"`{key}` {kind}, n_chars_kept bigint, n_tokens_kept bigint")
