"""Snapshot files of any size, read in splits of Spark's text source, from any store that it reads.

The runtime writes a key of the file, a row of numbers or a string to a line, and JSON keeps line ends out of strings.
So a line belongs to the section whose key came last before it, and splits can be decoded apart: a first pass finds the
keys (eight at most) and counts the numbers of each split, from which follows where in its column a split begins; a second
cuts the numbers at the borders of rows. Rows that lie across lines or splits are put together again. Strings are
numbered likewise and joined by their number. What the driver holds is the header and a count per section and split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heaploom import schema as S
from heaploom.plans.staging import free, stage
from heaploom.sources.heapsnapshot import needed_fields, sound, tables_from_files

#: Files above this many bytes are read in splits.
SPLIT_BYTES = 256 << 20
#: Keys of a file, and the fields of those sections that hold rows of numbers where the header does not name them.
SECTIONS = ("snapshot", "nodes", "edges", "trace_function_infos", "trace_tree", "samples", "locations", "strings")
NUMBERS = {
    "nodes": ("node_fields", ()),
    "edges": ("edge_fields", ()),
    "trace_function_infos": ("trace_function_info_fields", ("function_id", "name", "script_name", "script_id", "line", "column")),
    "samples": ("sample_fields", ("timestamp_us", "last_assigned_id")),
    "locations": ("location_fields", ("object_index", "script_id", "line", "column")),
}
KEY = r'^[\s{\]},]*"(' + "|".join(SECTIONS) + r')"\s*:'
#: Rows that are ordered, or edges of a node that are written out, at a time.
CHUNK = 1 << 16


class NotByLines(ValueError):
    """The file's keys do not begin lines, so it has to be read whole."""


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Lines with ``_block``, ``_line`` (in order), ``_section`` and ``_rest`` (the line without the key), and the header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), "value")
    marks = lines.select("_block", "_line", F.regexp_extract("value", KEY, 1).alias("key")).where("key != ''").collect()
    marks = sorted((m["_block"], m["_line"], m["key"]) for m in marks)
    keys = [k for _, _, k in marks]
    if len(set(keys)) < len(keys):
        raise ValueError("a key of the file occurs twice")
    if missing := {"snapshot", "nodes", "edges", "strings"} - set(keys):
        raise NotByLines(f"no line begins with the keys {sorted(missing)}")
    section = F.lit(-1)
    for block, line, key in marks:
        after = (F.col("_block") > block) | ((F.col("_block") == block) & (F.col("_line") >= line))
        section = F.when(after, F.lit(SECTIONS.index(key))).otherwise(section)
    lines = lines.select("_block", "_line", section.alias("_section"), F.regexp_replace("value", KEY, "").alias("_rest"))
    head = lines.where(F.col("_section") == 0).select("_block", "_line", "_rest").collect()
    text = "\n".join(r["_rest"] for r in sorted(head))
    return lines, json.JSONDecoder().raw_decode(text.lstrip())[0]


def _decoded(offsets: dict[tuple[int, int], int], widths: dict[int, int]):  # noqa: ANN202
    columns = max(widths.values())

    def rows(section: int, at: int, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``flat`` begins at number ``at`` of its section: what completes a row, whole rows, what begins one."""
        width = widths[section]
        lead = min(-at % width, len(flat))
        middle = lead + (len(flat) - lead) // width * width
        for a, z in ((0, lead), (lead, middle), (middle, len(flat))):
            if a == z:
                continue
            whole, first = a == lead and z == middle, at + a
            n = (z - a) // width if whole else 1
            values: list[pa.Array] = [pa.nulls(n, pa.int64())] * columns
            for c in range(width):
                if whole:
                    values[c] = pa.array(np.ascontiguousarray(flat[a + c : z : width]))
                elif 0 <= c - first % width < z - a:
                    values[c] = pa.array([int(flat[a + c - first % width])], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, section, np.int32)), pa.array(np.arange(n) + first // width), pa.array([whole] * n), *values], names=["_section", "_row", "_whole", *(f"_c{c}" for c in range(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            section, block = (b.column(i).to_numpy() for i in (0, 1))
            edges = np.concatenate([[0], np.flatnonzero((np.diff(section) != 0) | (np.diff(block) != 0)) + 1, [len(section)]])
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                flat = np.array([x for line in b.column(2).slice(a, z - a).to_pylist() for x in line.split(",")], np.int64)
                key = int(section[a]), int(block[a])
                at = seen.get(key, 0)
                seen[key] = at + len(flat)
                yield from rows(key[0], offsets[key] + at, flat)

    return run


def _number_rows(lines: DataFrame, widths: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """The rows of all sections of numbers, in a folder for each, and how many rows each has."""
    held = lines.where(F.col("_section").isin(list(widths)))
    clean = F.btrim(F.translate("_rest", "[]} \t\r", ""), F.lit(","))
    held = held.select("_section", "_block", clean.alias("_numbers")).where("_numbers != ''")
    size = F.length("_numbers") - F.length(F.replace("_numbers", F.lit(","), F.lit(""))) + 1
    found = held.groupBy("_section", "_block").agg(F.sum(size).alias("n"), F.min(F.col("_numbers").rlike(r"^\d+(,\d+)*$")).alias("good")).collect()
    offsets, totals = {}, dict.fromkeys(widths, 0)
    for r in sorted(found, key=lambda r: (r["_section"], r["_block"])):
        if not r["good"]:
            raise ValueError(f"{SECTIONS[r['_section']]} holds something else than numbers from 0 up")
        offsets[r["_section"], r["_block"]] = totals[r["_section"]]
        totals[r["_section"]] += r["n"]
    for s, n in totals.items():
        if n % widths[s]:
            raise ValueError(f"{n} numbers are not rows of {widths[s]}")
    shape = "_section int, _row bigint, _whole boolean, " + ", ".join(f"_c{c} bigint" for c in range(max(widths.values())))
    return stage(held.mapInArrow(_decoded(offsets, widths), shape), "split-rows", by="_section"), {s: n // widths[s] for s, n in totals.items()}


def _strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, int] = {}
    for b in batches:
        at, texts, blocks = [], [], []
        for block, line in zip(*(c.to_pylist() for c in b.columns)):
            # a string ends at its quote, so nothing of it is stripped
            inner = line.lstrip(" \t\r,[").rstrip(" \t\r,]}")
            for text in json.loads(f"[{inner}]"):
                blocks.append(block)
                texts.append(sound(text))
                at.append(seen.get(block, 0))
                seen[block] = at[-1] + 1
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(at, pa.int64()), pa.array(texts, pa.string())], names=["_block", "_at", "text"])


def _strings(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Strings (number, text)."""
    own = stage(lines.where(F.col("_section") == SECTIONS.index("strings")).select("_block", "_rest").mapInArrow(_strings_of, "_block bigint, _at bigint, text string"), "split-strings")
    first, at = [], 0
    for r in sorted(own.groupBy("_block").count().collect()):
        first.append((r["_block"], at))
        at += r["count"]
    # a row for each split
    starts = spark.createDataFrame(first, "_block bigint, _first bigint")
    return own.join(F.broadcast(starts), "_block").select((F.col("_first") + F.col("_at")).alias("number"), "text")


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Allocation nodes from the nested lists of the file, which come in order; what is held is as deep as the tree."""
    stack: list[list[int]] = []  # for each open list: its owner, fields seen of the current node, and the node
    for b in batches:
        found = []
        for line in b.column(0).to_pylist():
            for token in re.findall(r"[\[\]]|\d+", line):
                if token == "[":
                    stack.append([stack[-1][2] if stack else 0, 0, 0])
                elif token == "]":
                    stack.pop()
                    if stack:
                        stack[-1][1] = 0
                else:
                    level = stack[-1]
                    if level[1] == 0:
                        level[2] = int(token)
                    elif level[1] == 1:
                        found.append((level[2], level[0], int(token)))
                    level[1] += 1
        ids, parents, functions = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, parents, functions)], names=["id", "parent", "func_idx"])


def _label(code: Column, labels: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), code.cast("int")), F.lit("unknown"))


def tables_in_splits(spark: SparkSession, path: str, snapshot_id: int) -> dict[str, DataFrame]:
    """The tables of one file; no task holds more than a split of it.

    Raises ``NotByLines`` where keys do not begin lines, and ``ValueError`` for what the reader of whole files refuses too.
    An allocation tree is read by one task as a stream.
    """
    lines, head = _lines(spark, path)
    meta = head["meta"]
    fields = {SECTIONS.index(s): {f: i for i, f in enumerate(meta.get(key) or default)} for s, (key, default) in NUMBERS.items()}
    needed_fields(meta)
    rows, sizes = _number_rows(lines, {s: max(1, len(f)) for s, f in fields.items()})
    strings = stage(_strings(spark, lines), "split-numbered-strings")

    def section(name: str) -> DataFrame:
        s = SECTIONS.index(name)
        own = rows.where(F.col("_section") == s)
        columns = [f"_c{i}" for i in range(len(fields[s]))]
        cut = own.where("not _whole").groupBy("_row").agg(*(F.max(c).alias(c) for c in columns))
        every = own.where("_whole").select("_row", *columns).unionByName(cut)
        return every.select("_row", *(F.col(f"_c{i}").alias(f"f_{f}") for f, i in fields[s].items()))

    def named(df: DataFrame, number: str, name: str) -> DataFrame:
        found = strings.select(F.col("number").alias("_number"), F.col("text").alias(f"_{name}"))
        return df.join(found, df[number] == found["_number"], "left").drop("_number").withColumn(name, F.coalesce(f"_{name}", F.lit("")))

    def shaped(df: DataFrame, ddl: str) -> DataFrame:
        df = df.withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))
        columns = [c.split() for c in ddl.split(", ")]
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns))

    nf, ef = fields[SECTIONS.index("nodes")], fields[SECTIONS.index("edges")]
    raw = section("nodes")
    optional = {c: F.col(f"f_{f}") for c, f in (("raw_detachedness", "detachedness"), ("trace_node_id", "trace_node_id")) if f in nf}
    nodes = named(raw, "f_name", "name").withColumns({"ord": F.col("_row"), "type": _label(F.col("f_type"), meta["node_types"][nf["type"]]), "id": F.col("f_id"), "self_size": F.col("f_self_size"), "edge_count": F.col("f_edge_count"), **optional})

    degrees = raw.select(F.col("_row").alias("src"), F.col("f_edge_count").alias("n"), F.expr(f"_row div {CHUNK}").alias("_chunk"))
    # sums of chunks, one row each, then within chunks
    sums = degrees.groupBy("_chunk").agg(F.sum("n").alias("_n"))
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    n_edges = sizes[SECTIONS.index("edges")]
    if total != n_edges:
        raise ValueError(f"nodes claim {total} edges, the file has {n_edges}")
    before = sums.select("_chunk", (F.sum("_n").over(Window.orderBy("_chunk")) - F.col("_n")).alias("_before"))
    inner = F.sum("n").over(Window.partitionBy("_chunk").orderBy("src")) - F.col("n")
    firsts = degrees.withColumn("_inner", inner).join(before, "_chunk").select("src", "n", (F.col("_before") + F.col("_inner")).alias("_first")).where("n > 0")
    steps = firsts.select("src", "n", "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    owners = steps.select("src", "_first", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("n")) - 1)).alias("pos"))
    owners = owners.select("src", "pos", (F.col("_first") + F.col("pos")).alias("eid"))
    edges = section("edges").withColumns({"eid": F.col("_row"), "dst": F.expr(f"f_to_node div {len(nf)}"), "type": _label(F.col("f_type"), meta["edge_types"][ef["type"]])}).join(owners, "eid")
    numbered = F.col("type").isin(*S.INDEXED_EDGES)
    edges = shaped(edges.where(numbered).withColumn("idx", F.col("f_name_or_index")), S.EDGES).unionByName(shaped(named(edges.where(~numbered), "f_name_or_index", "name"), S.EDGES))

    locations = section("locations").withColumns({"seq": F.col("_row"), "ord": F.expr(f"f_object_index div {len(nf)}"), "script_id": F.col("f_script_id"), "line": F.col("f_line"), "col": F.col("f_column")})
    samples = section("samples").withColumns({"seq": F.col("_row"), "timestamp_us": F.col("f_timestamp_us"), "last_assigned_id": F.col("f_last_assigned_id")})
    functions = named(named(section("trace_function_infos"), "f_name", "function_name"), "f_script_name", "script_name")
    functions = functions.withColumns({"idx": F.col("_row"), "script_id": F.col("f_script_id"), "line": F.col("f_line"), "col": F.col("f_column")})
    tree = lines.where(F.col("_section") == SECTIONS.index("trace_tree")).repartition(1).sortWithinPartitions("_block", "_line").select("_rest")
    tree = stage(tree.mapInArrow(_tree, "id bigint, parent bigint, func_idx bigint"), "split-tree")
    info = (path, sizes[SECTIONS.index("nodes")], n_edges, head.get("root_index", 0) // len(nf), head.get("extra_native_bytes", 0), "detachedness" in nf, "trace_node_id" in nf and not tree.isEmpty())
    about = spark.createDataFrame([(snapshot_id, *info)], S.SNAPSHOTS)
    made = {"nodes": shaped(nodes, S.NODES), "edges": edges, "locations": shaped(locations, S.LOCATIONS), "samples": shaped(samples, S.SAMPLES), "trace_nodes": shaped(tree, S.TRACE_NODES), "trace_functions": shaped(functions, S.TRACE_FUNCTIONS)}
    out = {name: stage(t, f"snapshot-{name}") for name, t in made.items()} | {"snapshots": about}
    free(rows, strings, tree)
    return out


def load_tables(spark: SparkSession, paths: str, split_bytes: int = SPLIT_BYTES) -> dict[str, DataFrame]:
    """The tables of all snapshot files that ``paths`` matches, staged: files above ``split_bytes`` in splits, others a task each."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.xxhash64("path").alias("sid")).collect()
    parts, whole = [], [f["path"] for f in files if f["length"] <= split_bytes]
    for f in files:
        if f["length"] > split_bytes:
            try:
                parts.append(tables_in_splits(spark, f["path"], f["sid"]))
            except NotByLines:
                whole.append(f["path"])
    if whole or not files:
        found = tables_from_files(spark, whole or paths)
        parts.append({k: stage(v, f"snapshot-{k}") for k, v in found.items()})
    out = parts[0]
    for more in parts[1:]:
        out = {k: out[k].unionByName(more[k]) for k in out}
    return out
