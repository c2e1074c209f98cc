"""Snapshot files read in splits, against the reader of whole files."""

import json

import pytest
from pyspark.sql import functions as F

from heaploom.sources import heapsnapshot, splits
from tests.graphs import Heap
from tests.test_snapshot import app


def by_lines(content, rows_a_line=1, spread=False):
    """The file as the runtime lays it out, with some rows to a line; ``spread``: each number on a line of its own."""
    raw = json.loads(content)
    if spread:
        return json.dumps(raw, indent=1)
    parts = ['{"snapshot":' + json.dumps(raw["snapshot"], separators=(",", ":"))]
    keys = {"nodes": "node_fields", "edges": "edge_fields", "trace_function_infos": "trace_function_info_fields", "samples": "sample_fields", "locations": "location_fields"}
    for key, fields in keys.items():
        flat, width = raw.get(key) or [], max(1, len(raw["snapshot"]["meta"].get(fields) or [])) * rows_a_line
        parts.append(f'"{key}":[' + "\n,".join(",".join(map(str, flat[i : i + width])) for i in range(0, len(flat), width)) + "\n]")
    parts.append('"trace_tree":' + json.dumps(raw.get("trace_tree") or []).replace(" ", "\n"))
    parts.append('"strings":[' + ",\n".join(json.dumps(s) for s in raw["strings"]) + "]}")
    return ",\n".join(parts)


def awkward():
    h = app()
    for i, text in enumerate(['"nodes":[1', ' ],}', "a\nb,c", "é😀", "\ud800x", "[", "\\", ""]):
        h.add(f"odd{i}", "string", text, 1).link("A", f"odd{i}", "property", text)
    h.add("hub")
    for i in range(300):
        h.add(f"leaf{i}", "object", f"name {i}", i).link("hub", f"leaf{i}", "element" if i % 3 else "property", i if i % 3 else f"p{i}")
    return h.link("R", "hub")


def same(spark, path, content, whole=None):
    path.write_text(content, encoding="utf-8", errors="surrogatepass") if isinstance(content, str) else path.write_bytes(content)
    url = spark.read.format("binaryFile").load(str(path)).select("path").first()[0]
    found = splits.tables_in_splits(spark, url, 9)
    want = heapsnapshot.tables_from_bytes(spark, whole or path.read_bytes(), 9, url)
    for name, table in want.items():
        assert found[name].schema.simpleString() == table.schema.simpleString(), name
        assert sorted(map(str, found[name].collect())) == sorted(map(str, table.collect())), name
    return found


@pytest.mark.parametrize("rows_a_line,spread,split", [(1, False, 1500), (5, False, 4000), (1, True, 3000), (1, False, 128 << 20)])
def test_splits_read_what_the_whole_reader_reads(spark, tmp_path, monkeypatch, rows_a_line, spread, split):
    monkeypatch.setattr(splits, "CHUNK", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        text = by_lines(awkward().content(), rows_a_line, spread)
        same(spark, tmp_path / "a.heapsnapshot", text)
        n = spark.read.text(str(tmp_path / "a.heapsnapshot")).select("_metadata.file_block_start").distinct().count()
        assert (n > 4) == (split < 1 << 20)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_without_side_tables(spark, tmp_path):
    h = Heap()
    h.add("A", size=3).link("R", "A")
    same(spark, tmp_path / "b.heapsnapshot", by_lines(h.content()))


@pytest.mark.parametrize("old,new,why", [('"nodes":[', '"nodes":[-', "else than numbers"), ('"edges":[', '"edges":[1,', "rows of"), ('"samples"', '"locations"', "twice"), ('"edge_count"', '"edge_number"', "lacks")])
def test_broken_files_are_refused(spark, tmp_path, old, new, why):
    path = tmp_path / "c.heapsnapshot"
    path.write_text(by_lines(app().content()).replace(old, new, 1))
    with pytest.raises(ValueError, match=why):
        splits.tables_in_splits(spark, str(path), 1)


def test_large_small_and_one_line_files_side_by_side(spark, tmp_path):
    h = awkward()
    (tmp_path / "large.heapsnapshot").write_text(by_lines(h.content()))
    (tmp_path / "line.heapsnapshot").write_bytes(h.content())
    small = Heap()
    small.add("A", size=3).link("R", "A")
    (tmp_path / "small.heapsnapshot").write_bytes(small.content())
    with pytest.raises(splits.NotByLines):
        splits.tables_in_splits(spark, str(tmp_path / "line.heapsnapshot"), 1)
    got = splits.load_tables(spark, f"{tmp_path}/*.heapsnapshot", split_bytes=2000)
    want = heapsnapshot.tables_from_files(spark, f"{tmp_path}/*.heapsnapshot")
    for name in want:
        assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect())), name
    assert got["snapshots"].select(F.countDistinct("snapshot_id")).first()[0] == 3
