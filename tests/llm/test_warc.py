"""Archives written and read back, whole, damaged, plain and mixed."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heaploom.llm import common, warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


PAGES = [(1, "http://a/é?q=1 2\r\nX: y", "same"), (2, None, "same"), (3, "http://b/", ""), (4, "", None), (5, "u", "one"), (5, "u", "one"), (6, "u", "two"), (6, "v", "two"), (7, "u", "two"), (None, "n", "same"), (None, "n", "lost"), (None, "n", "lost"), (8, "w", "WARC/1.1\r\nWARC-Type: x\r\n\r\n"), (-9, "x", "日本\x00\r\n\r\n" * 50), (10, "big", "x" * (17 << 20)), (11, "m", "\x1f\x8b\x08 no member")]


def expected(rows, least=0):
    text = lambda t: (t or "").encode()
    out = []
    for page, _, t in rows:
        ids = [p for p, _, u in rows if text(u) == text(t) and p is not None]
        keep = min(ids, default=None)
        again = len(text(t)) >= least and page != keep
        out.append((page, len(text(t)), b32(text(t)), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({"type": F.lit(1), "_n": F.lit(2), "gap": F.lit("g")})
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(warc.archived_pages(df), *shown) == expected(PAGES)
    assert warc.archived_pages(df.limit(0)).count() == 0
    path = common.shared_path(spark, "warc-test")
    warc.write_archives(df.repartition(3), path, min_bytes=4, archive_bytes=1 << 20)
    read = warc.read_archives(spark, path)
    assert warc.gaps(read).isEmpty()
    found = warc.records(read)
    assert rows_of(found.select(warc.page_of(F.col("record_id"), df.schema["page_id"].dataType).alias("p"), "payload_bytes", "payload_digest", "type", warc.page_of(F.col("refers_to"), df.schema["page_id"].dataType).alias("r")), "p", "payload_bytes", "payload_digest", "type", "r") == expected(PAGES, 4)
    payloads = {(t or "").encode() for _, _, t in PAGES}
    assert {bytes(r["payload"]) for r in found.where("type = 'response'").collect()} == payloads
    assert {r["target_uri"] for r in found.where("record_id like '%:1'").collect()} == {"http://a/%C3%A9?q=1%202%0D%0AX:%20y"}


def test_text_keys_survive_their_escapes(spark):
    rows = [("a b+c%41>é", "u", "x"), ("", "u", "y"), ("z", "u", "x")]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id string, url string, html string"))
    assert {(r["page_id"], r["refers_to"]) for r in got.collect()} == {("a b+c%41>é", None), (None, None), ("z", "a b+c%41>é")}


def some(n=12, seed=1):
    rng = random.Random(seed)
    return [warc.record(f"urn:x:{i}", f"http://h/{i}", bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))), None, "2020-01-01T00:00:00Z") for i in range(n)]


def ids(data):
    return [x["record_id"] for _, _, x in warc.salvage(data) if isinstance(x, dict)]


def covered(data):
    """Ranges of what salvage finds cover the bytes, gaps and records in turn."""
    at, gaps = 0, []
    for a, b, x in warc.salvage(data):
        assert a == at or isinstance(x, dict) and b == at, (a, b, at)
        if isinstance(x, str) and a == at:
            gaps.append((a, b))
        at = max(at, b)
    assert at == len(data)
    return gaps


@pytest.mark.parametrize("pack", [warc.member, bytes, gzip.compress])
def test_any_damaged_byte_costs_one_record(pack):
    parts = [pack(r) for r in some()]
    whole = b"".join(parts)
    assert ids(whole) == [f"urn:x:{i}" for i in range(12)] and covered(whole) == []
    rng, starts = random.Random(4), [sum(map(len, parts[:i])) for i in range(13)]
    for _ in range(150):
        at = rng.randrange(len(whole))
        broken = whole[:at] + bytes([whole[at] ^ rng.randrange(1, 256)]) + whole[at + 1 :]
        hit = max(i for i in range(12) if starts[i] <= at)
        got = ids(broken)
        assert {f"urn:x:{i}" for i in range(12) if i != hit} <= set(got) and len(got) <= 12
        gaps = covered(broken)
        # bytes no check covers (a member's time, a header's words) may change without a loss
        assert len(got) == 12 or gaps and all(starts[hit] <= a and b <= starts[hit + 1] for a, b in gaps)


def test_cuts_garbage_and_mixtures():
    r = some()
    a, b, c = (b"".join(map(warc.member, r[i : i + 4])) for i in (0, 4, 8))
    mixed = b"junk WARC/1.1 \x1f\x8b\x08" + a + b"\0" * 700 + b"".join(r[4:8]) + b"WARC/1.0\r\nx" + c
    assert ids(mixed) == [f"urn:x:{i}" for i in range(12)] and len(covered(mixed)) == 3
    # an archive packed as one member, with a broken record within
    inner = r[0] + r[1][:-30] + r[2]
    found = list(warc.salvage(warc.member(inner)))
    assert [x["record_id"] if isinstance(x, dict) else "gap" for _, _, x in found] == ["urn:x:0", "gap", "urn:x:2"]
    cut = (a + b)[: len(a) + 40]
    assert ids(cut) == [f"urn:x:{i}" for i in range(4)] and covered(cut) == [(len(a), len(cut))]
    assert list(warc.salvage(b"")) == [] and covered(b"\x1f\x8b\x08") == [(0, 3)]
    lower = r[0].replace(b"WARC-Type", b"warc-type").replace(b"WARC/1.1", b"WARC/1.0").replace(b"WARC-Date: ", b"WARC-Date:\r\n  ")
    assert ids(lower) == ["urn:x:0"]


def test_archives_from_elsewhere_are_salvaged_file_by_file(spark, tmp_path):
    parts = [warc.member(x) for x in some()]
    (tmp_path / "good.warc.gz").write_bytes(b"".join(parts[:6]))
    bad = bytearray(b"".join(parts[6:]))
    bad[len(parts[6]) + 60] ^= 255
    (tmp_path / "bad.warc.gz").write_bytes(bad)
    (tmp_path / "empty.warc").write_bytes(b"")
    read = warc.read_archives(spark, str(tmp_path))
    assert {r["record_id"] for r in warc.records(read).collect()} == {f"urn:x:{i}" for i in range(12) if i != 7}
    (gap,) = warc.gaps(read).collect()
    assert gap["archive"].endswith("bad.warc.gz") and (gap["at"], gap["length"]) == (len(parts[6]), len(parts[7])) and gap["gap"]
