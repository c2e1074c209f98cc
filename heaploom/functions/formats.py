"""Formatting and parsing, as column expressions wherever one exists."""

from __future__ import annotations

import re
import string
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from heaploom.schema import NO_DISTANCE, PAIR_WORDS, UNREACHABLE_BASE

MINUS = "−"
BAR, BAR_WIDTH = "█", 50


def format_size(n: Column) -> Column:
    kb = F.format_string("%d kB", F.round(n / 1024).cast("long"))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, kb).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    share = F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)
    return F.format_string(f"%.{digits}f%%", share)


def signed_count(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), format_count(n))).when(n < 0, F.concat(F.lit(MINUS), format_count(-n))).otherwise("0")


def signed_size(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), format_size(n))).when(n < 0, F.concat(F.lit(MINUS), format_size(-n))).otherwise("0 B")


def format_distance(d: Column) -> Column:
    deep = F.concat(F.lit("U+"), (d - UNREACHABLE_BASE).cast("string"))
    return F.when(d == NO_DISTANCE, "N").when(d == UNREACHABLE_BASE, "U").when(d > UNREACHABLE_BASE, deep).otherwise(d.cast("string"))


def seconds(us: Column) -> Column:
    return F.round(us / 1e6, 1)


def bar(value: Column, most: Column) -> Column:
    return F.repeat(F.lit(BAR), F.when(most > 0, F.round(value * BAR_WIDTH / most)).otherwise(0).cast("int"))


def node_label(id_: Column, name: Column) -> Column:
    return F.concat(F.lit("@"), id_.cast("string"), F.lit(" "), name)


def edge_label(kind: Column, name: Column, idx: Column) -> Column:
    return F.when(kind.isin("element", "hidden"), F.format_string("[%d]", idx)).when(F.coalesce(name, F.lit("")) == "", "??").otherwise(name)


def edge_ref(edge: Column, node: Column) -> Column:
    return F.concat(edge, F.lit(" :: "), node)


def retainer_label(edge: Column, node: Column) -> Column:
    return F.concat(edge, F.lit(" in "), node)


def edge_refs(name: Column) -> Column:
    """The three objects that a WeakMap pair's edge name tells of; an empty array for other names."""
    first, second, third = map(F.lit, PAIR_WORDS)
    between = lambda text, before, after: F.substring_index(F.substr(text, F.locate(before, text) + F.length(F.lit(before))), after, 1)
    key, value = between(name, PAIR_WORDS[0], PAIR_WORDS[1]), between(name, PAIR_WORDS[1], PAIR_WORDS[2])
    table = F.rtrim(F.substr(name, F.locate(PAIR_WORDS[2], name) + F.length(third)), F.lit(")"))
    number = F.substring_index(name, PAIR_WORDS[0], 1)
    label, id_ = (lambda part: F.substr(part, F.lit(1), F.length(part) - F.length(F.substring_index(part, " @", -1)) - 2)), (lambda part: F.substring_index(part, " @", -1))
    whole = F.contains(name, first) & F.contains(name, second) & F.contains(name, third) & name.endswith(")")
    for digits in (number, id_(key), id_(value), table):
        whole = whole & digits.rlike("^[0-9]+$")
    ref = lambda said, i: F.struct(said.alias("label"), i.try_cast("long").alias("id"))
    refs = F.array(ref(F.concat(F.lit("key/"), label(key)), id_(key)), ref(F.concat(F.lit("value/"), label(value)), id_(value)), ref(F.lit("table"), table))
    return F.when(whole, refs).otherwise(F.array().cast("array<struct<label:string,id:bigint>>"))


def contains_folded(text: Column, part: str, ascii_only: bool = False) -> Column:
    """Whether ``part`` occurs in either case; only that of A-Z is disregarded if asked for."""
    if ascii_only:
        upper, lower = string.ascii_uppercase, string.ascii_lowercase
        return F.contains(F.translate(text, upper, lower), F.lit(part.translate(str.maketrans(upper, lower))))
    return F.contains(F.lower(text), F.lit(part.lower()))


def has_tag(name: Column, tag: str) -> Column:
    return name.endswith(f" {tag}") | F.contains(name, F.lit(f" {tag} / "))


def quote_property(name: Column) -> Column:
    """A property's name as labels show it: in quotes if it holds a comma, a quote or a brace."""
    held = F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r'(?s)^\{"n":(.*)\}$', 1)
    return F.when(name.rlike("[,'\"{}]"), held).otherwise(name)


def symbol_property(name: Column) -> Column:
    """A property's name as interfaces show it."""
    return F.when(F.startswith(name, F.lit("Symbol(")), F.concat(F.lit("<symbol "), F.substr(name, F.lit(8), F.greatest(F.length(name) - 8, F.lit(0))), F.lit(">"))).otherwise(name)


def wasted(total: Column, one: Column) -> Column:
    return total - one


# -- widths of text on a terminal ----------------------------------------------------


def char_width(c: str) -> int:
    if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def width(text: str, cap: int | None = None) -> int:
    n = 0
    for c in text:
        n += char_width(c)
        if cap is not None and n >= cap:
            return cap
    return n


def pad(text: str, to: int) -> str:
    return text + " " * max(0, to - width(text))


def slice_width(text: str, start: int, size: int) -> str:
    out, at = [], 0
    for c in text:
        w = char_width(c)
        if at >= start and at + w <= start + size:
            out.append(c)
        at += w
    return "".join(out)


def truncate(text: str, to: int) -> str:
    if width(text) <= to:
        return text
    return slice_width(text, 0, to - 1) + "…" if to else ""


def display_width(text: Column) -> Column:
    @F.pandas_udf("int")
    def widths(s: pd.Series) -> pd.Series:
        return s.fillna("").map(width)

    return F.when(F.octet_length(text) == F.char_length(text), F.char_length(text)).otherwise(widths(text))


def truncated(text: Column, to: int) -> Column:
    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: truncate(x, to))

    return F.when(F.octet_length(text) <= to, text).otherwise(cut(text))


# -- positions in UTF-16 text -----------------------------------------------------------


def utf16_to_utf8(text: str, offset: int) -> int | None:
    """Byte offset of a UTF-16 offset; None past the end and inside a surrogate pair."""
    at = 0
    for i, c in enumerate(text):
        if at == offset:
            return len(text[:i].encode())
        at += 2 if ord(c) > 0xFFFF else 1
    return len(text.encode()) if at == offset else None


def utf16_line_cols(text: str, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each offset is a place in ``text``, and its zero-based line and UTF-16 column; only line feeds end a line.

    The text is looked at once: its units, the places at which lines start, and a search among these.
    """
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    offsets = np.asarray(offsets, np.int64)
    sound = (offsets >= 0) & (offsets <= len(units))
    at = np.where(sound, offsets, 0)
    # the second unit of a pair is no place
    inside = np.append((units >= 0xDC00) & (units < 0xE000), False)
    starts = np.append(0, np.flatnonzero(units == 10) + 1)
    line = np.searchsorted(starts, at, side="right") - 1
    return sound & ~inside[at], line, at - starts[line]


def utf16_line_col(text: str, offset: int) -> tuple[int, int] | None:
    """Zero-based line and UTF-16 column; only line feeds end a line."""
    sound, line, col = utf16_line_cols(text, np.array([offset]))
    return (int(line[0]), int(col[0])) if sound[0] else None


def line_col(text: str, byte: int) -> tuple[int, int]:
    """One-based line and character column of a byte offset."""
    head = text.encode()[:byte].decode(errors="ignore")
    return head.count("\n") + 1, len(head.rpartition("\n")[2]) + 1


# -- options ----------------------------------------------------------------------------

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "KIB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "MIB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "GIB": 1 << 30}


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in _UNITS:
        raise ValueError(f"not a size: {text!r}; try 64K or 1 MiB")
    n = int(m[1]) * _UNITS[m[2].upper()]
    if n >= 1 << 64:
        raise ValueError(f"too large a size: {text!r}")
    return n


def parse_object_id(text: str) -> int:
    m = re.fullmatch(r"@?(\d+)", text.strip())
    if not m:
        raise ValueError(f"not an object id: {text!r}; expected a form like @12345")
    return int(m[1])


def parse_window(text: str) -> tuple[str, int | None, int | None]:
    """``name``, ``name:start`` or ``name:start:count``; the name may hold colons."""
    parts, numbers = text.split(":"), []
    while len(parts) > 1 and len(numbers) < 2 and parts[-1].isascii() and parts[-1].isdigit():
        numbers.append(int(parts.pop()))
    start, count = [*reversed(numbers), None, None][:2]
    return ":".join(parts), start, count
