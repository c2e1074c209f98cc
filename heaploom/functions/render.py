"""Results as text, for terminals and tools; rows are a page, not a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from heaploom.functions.formats import pad, truncate, width


def table(df: DataFrame, columns: list[str] | None = None, limit: int = 100, widest: int = 60) -> str:
    """A page of rows in columns, cut to a width, with a status line if there is more."""
    columns = columns or df.columns
    rows = df.select(*columns).limit(limit + 1).collect()
    cells = [[truncate("" if v is None else str(v), widest) for v in r] for r in rows[:limit]]
    wide = [max([width(c), *(width(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    lines = ["  ".join(pad(v, w) for v, w in zip(r, wide)).rstrip() for r in [columns, *cells]]
    lines.append(f"1–{len(cells)} of {'more' if len(rows) > limit else len(cells)}" if cells else "no rows")
    return "\n".join(lines)


def tree(df: DataFrame, label: str, depth: str = "depth", limit: int = 1000) -> str:
    return "\n".join("  " * r[depth] + str(r[label]) for r in df.limit(limit).collect())


def json_lines(df: DataFrame, limit: int = 1000) -> str:
    return "\n".join(df.limit(limit).toJSON().collect())
