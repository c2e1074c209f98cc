"""Counting quotient filters over packed n-grams of word ids: exact counts in few bytes.

Ids of ``bits`` bits are packed into a key of two halves, and four Feistel rounds permute it.
The permutation can be undone, so the filter is no sketch: the leading bits of a permuted key
are its quotient, all others its remainder, and both together give the n-gram back. Keys come
out even over the quotients whatever n-grams are frequent, so ranges of quotients are even
shares of the work.

A filter holds its keys in their order: one bit per quotient that occurs, one bit per key for
the ends of runs of one quotient, the remainders in whole bytes, and one byte per count (255:
the count stands in a list of its own). Filters over the same ranges merge by merging sorted
runs.
"""

from __future__ import annotations

import struct

import numpy as np

from heaploom.llm.words import mix64

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Bits of a quotient, about: as many quotients as a block has n-grams.
QUOTIENT_BITS = 20
_HEAD = "<II"


def _u(x: int) -> np.uint64:
    return np.uint64(x)


class Layout:
    """How n-grams of ``n`` ids (2 or 3) below ``2 ** bits`` are laid out in ``2 ** range_bits`` ranges of quotients."""

    def __init__(self, n: int, bits: int, range_bits: int) -> None:
        if n not in (2, 3) or bits > 42:
            raise ValueError("n-grams have 2 or 3 ids of 42 bits at most")
        self.n, self.bits = n, bits + bits % 2
        self.half = self.bits if n == 2 else self.bits * 3 // 2
        #: Whether a key fits one 64-bit word; otherwise its low half is kept apart.
        self.single = 2 * self.half <= 64
        top = 2 * self.half if self.single else self.half
        self.remainder_bytes = max(0, round((top - QUOTIENT_BITS) / 8))
        self.q = top - 8 * self.remainder_bytes
        self.low_bytes = 0 if self.single else -(-self.half // 8)
        self.p = min(range_bits, self.q)

    def permuted(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
        """Keys of n-grams; ``ids`` holds a column for each place."""
        columns = [x.astype(np.uint64) for x in ids]
        if self.n == 2:
            left, right = columns
        else:
            k = self.bits // 2
            left = (columns[0] << _u(k)) | (columns[1] >> _u(k))
            right = ((columns[1] & _u((1 << k) - 1)) << _u(self.bits)) | columns[2]
        mask = _u((1 << self.half) - 1)
        for c in _ROUNDS:
            left, right = right, left ^ (mix64(right + _u(c)) & mask)
        return ((left << _u(self.half)) | right, None) if self.single else (left, right)

    def ids(self, top: np.ndarray, low: np.ndarray | None) -> list[np.ndarray]:
        """The n-grams of keys: the inverse of ``permuted``."""
        mask = _u((1 << self.half) - 1)
        left, right = (top >> _u(self.half), top & mask) if self.single else (top, low)
        for c in reversed(_ROUNDS):
            left, right = right ^ (mix64(left + _u(c)) & mask), left
        if self.n == 2:
            return [left.astype(np.int64), right.astype(np.int64)]
        k = self.bits // 2
        middle = ((left & _u((1 << k) - 1)) << _u(k)) | (right >> _u(self.bits))
        return [x.astype(np.int64) for x in (left >> _u(k), middle, right & _u((1 << self.bits) - 1))]


Entries = tuple[np.ndarray, np.ndarray | None, np.ndarray]


def summed(top: np.ndarray, low: np.ndarray | None, counts: np.ndarray | None = None) -> Entries:
    """Sorted keys, each once, with what its counts add up to (one each, where none are given)."""
    if low is None and counts is None:
        top = np.sort(top)
    else:
        # stable sorts are merges, which take sorted runs as they are
        order = np.argsort(top, kind="stable") if low is None else np.lexsort((low, top))
        top, low, counts = top[order], None if low is None else low[order], None if counts is None else counts[order]
    if not len(top):
        return top, low, np.zeros(0, np.int64)
    new = np.ones(len(top), bool)
    new[1:] = top[1:] != top[:-1]
    if low is not None:
        new[1:] |= low[1:] != low[:-1]
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(top))) if counts is None else np.add.reduceat(counts, first)
    return top[first], None if low is None else low[first], total.astype(np.int64)


def merged(parts: list[Entries]) -> Entries:
    """One sorted run from several."""
    if len(parts) == 1:
        return parts[0]
    low = None if parts[0][1] is None else np.concatenate([p[1] for p in parts])
    return summed(np.concatenate([p[0] for p in parts]), low, np.concatenate([p[2] for p in parts]))


def _to_bytes(x: np.ndarray, width: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :width]


def _from_bytes(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(n, width)
    return out.view("<u8").reshape(n).astype(np.uint64)


def encode(layout: Layout, entries: Entries) -> list[tuple[int, bytes]]:
    """(range, filter) of sorted entries, for each range of quotients that has any."""
    top, low, counts = entries
    quotient = top >> _u(8 * layout.remainder_bytes)
    place = (quotient >> _u(layout.q - layout.p)).astype(np.int64)
    ends = np.ones(len(top), bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    inside = (quotient & _u((1 << (layout.q - layout.p)) - 1)).astype(np.int64)
    remainders, lows = _to_bytes(top, layout.remainder_bytes), None if low is None else _to_bytes(low, layout.low_bytes)
    small = np.minimum(counts, 255).astype(np.uint8)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(first.tolist(), np.append(first[1:], len(place)).tolist(), strict=True):
        occupied = np.zeros(1 << (layout.q - layout.p), bool)
        occupied[inside[a:b]] = True
        large = counts[a:b][small[a:b] == 255].astype("<i8")
        parts = [struct.pack(_HEAD, b - a, len(large)), np.packbits(occupied).tobytes(), np.packbits(ends[a:b]).tobytes(), remainders[a:b].tobytes(), b"" if lows is None else lows[a:b].tobytes(), small[a:b].tobytes(), large.tobytes()]
        out.append((int(place[a]), b"".join(parts)))
    return out


def decode(layout: Layout, place: int, data: bytes) -> Entries:
    """The entries of a filter of range ``place``, in their order."""
    n, n_large = struct.unpack_from(_HEAD, data)
    raw, at = np.frombuffer(data, np.uint8), struct.calcsize(_HEAD)

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return raw[at - size : at]

    space = 1 << (layout.q - layout.p)
    occupied = np.flatnonzero(np.unpackbits(take(-(-space // 8)), count=space))
    ends = np.unpackbits(take(-(-n // 8)), count=n)
    run = np.cumsum(ends) - ends
    quotient = (occupied[run] + (place << (layout.q - layout.p))).astype(np.uint64)
    width = layout.remainder_bytes
    top = (quotient << _u(8 * width)) | _from_bytes(take(n * width), width, n)
    low = None if layout.single else _from_bytes(take(n * layout.low_bytes), layout.low_bytes, n)
    counts = take(n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(take(8 * n_large).tobytes(), "<i8")
    return top, low, counts


class Merger:
    """Adds filters of one range up. What waits is merged once it is as large as what has been merged."""

    def __init__(self, least: int = 1 << 18) -> None:
        self.done: Entries | None = None
        self.waiting: list[Entries] = []
        self.size, self.least = 0, least

    def add(self, entries: Entries) -> None:
        self.waiting.append(entries)
        self.size += len(entries[0])
        if self.size >= max(self.least, 0 if self.done is None else len(self.done[0])):
            self.result()

    def result(self) -> Entries | None:
        if self.waiting:
            self.done = merged(([self.done] if self.done is not None else []) + self.waiting)
            self.waiting, self.size = [], 0
        return self.done
