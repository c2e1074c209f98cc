"""Words of a whole Arrow batch as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below ``n`` at least. Only those for a chunk are kept."""
    if n > len(_UP):
        return powers(BASE, n), powers(INVERSE, n)
    return _UP, _DOWN


_UP, _DOWN = powers(BASE, CHUNK_BYTES + 1), powers(INVERSE, CHUNK_BYTES + 1)


class WordHasher:
    """Splits texts at space and \\x09-\\x0D, lower-cases A-Z, and hashes each word.

    A word's hash is a polynomial in its bytes, read off running sums of the whole chunk,
    so the work is a few passes over the bytes.
    """

    def __init__(self) -> None:
        b = np.arange(256)
        self.blank = (b == 32) | ((b >= 9) & (b <= 13))
        self.value = (np.where((b >= 65) & (b <= 90), b + 32, b) + 1).astype(np.uint64)

    def spans(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words of texts laid end to end, and each word's first byte and end."""
        n = len(data)
        up, down = power_tables(n + 1)
        solid = np.zeros(n + 1, bool)
        np.logical_not(self.blank[data], out=solid[:n])
        first = solid[:n].copy()
        first[1:] &= ~solid[: n - 1]
        last = solid[:n] & ~solid[1:]
        cuts = ends[(ends > 0) & (ends < n)]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * up[:n], out=sums[1:])
        words = mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
        return words, start, stop

    def chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of texts laid end to end, and where each text's words end."""
        words, start, _ = self.spans(data, ends)
        return words, np.searchsorted(start, ends, side="left")

    def documents(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Chunks of a column of texts: index of the first, word hashes, end of each text's words."""
        for at, data, ends in text_chunks(texts):
            yield (at, *self.chunk(data, ends))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A column of texts in stretches of bytes: index of the first, bytes, end of each text in them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def shingles(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within each text, and where each text's end.

    A text with fewer words has its whole sequence as its one shingle; one without has none.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = ends - starts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_ends = np.cumsum(n)
    place = np.arange(int(out_ends[-1]) if len(out_ends) else 0, dtype=np.int64)
    at = place + np.repeat(starts - (out_ends - n), n)
    short = np.repeat(np.minimum(counts, size), n)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        part = padded[at + j]
        if len(short) and short.min() < size:
            part = np.where(short > j, part, np.uint64(0))
        total = total * np.uint64(0xD6E8FEB86659FD93) + part
    return mix64(total + short.astype(np.uint64)), out_ends
