"""WARC archives: a gzip member per record through Spark's text sink, and a reader that salvages."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType

from heaploom.llm.common import filter_words, join_groups, key_slots, shared_path, test_filter
from heaploom.plans.staging import stage

#: Payload bytes of an archive file, about. A file is read whole by one task.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a header at most, and of rows that a task hands on together.
MAX_HEAD, BATCH_BYTES = 1 << 16, 4 << 20

# The profile of revisits, the record ids' scheme, gzip's magic and an empty member.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:heaploom:page:"
MAGIC = b"\x1f\x8b\x08"
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def digest_of(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing -----------------------------------------------------------------------------


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record: a response with ``payload``, or where ``refers_to`` is given a revisit, which keeps its length and digest alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", "sha1:" + digest_of(payload)), ("WARC-Block-Digest", "sha1:" + digest_of(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that ends with a zero byte, as sizes under 16 MB do; behind a larger one an empty member stands."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out.endswith(b"\0") else out + EMPTY


def _members(date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def uri(page: str | None) -> str:
        return URN + ("" if page is None else quote(page, safe=""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, payload, revisit, kept in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), *(c.to_pylist() for c in batch.columns[3:]), strict=True):
                data = member(record(uri(page), url, payload.as_py(), uri(kept) if revisit else None, date))
                out.append(data[:-1])  # the line separator is the last byte
                size += len(data)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    return run


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` to gzip archives in the folder ``path``, on any store that Spark writes to.

    Of rows with equal payloads (bytes, or a text in UTF-8; null: empty) of ``min_bytes`` at
    least, that with the smallest key is a response and the others are revisits of it. Rows
    alike in key and payload are one page given more than once: each of the smallest key is a
    response. A null key is above all others. A null url is left out. Other columns are
    ignored, whatever their names; a table without rows gives a folder without records.

    Every record is a gzip member of its own. Members end with a zero byte, which the text
    sink writes as its line separator, so Spark's own commit decides which files count, and a
    task that runs again leaves nothing behind. Only digests are grouped. A payload is
    shuffled only where its digest may recur and its group is not among the large ones, which
    are told to all tasks.
    """
    raw = F.col(payload) if isinstance(pages.schema[payload].dataType, BinaryType) else F.col(payload).cast("binary")
    rows = pages.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(raw, F.lit(b"")).alias("_payload"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_payload", 256)))
    sized = rows.select("_id", "_digest", F.octet_length("_payload").cast("long").alias("_bytes")).groupBy("_digest").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_bytes"))
    sized = stage(sized, "warc-digests")
    n, total = sized.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    groups = sized.where((F.col("_n") > 1) & (F.col("_bytes") >= F.col("_n") * min_bytes)).select("_digest", "_keep", "_n")
    words = filter_words(groups.count())
    tested = test_filter(rows, F.xxhash64("_digest"), key_slots(groups, "_digest", words), words)
    met = join_groups(tested.where("_maybe").drop("_maybe"), groups, "_digest", "_n", n)
    alone = tested.where("not _maybe").drop("_maybe").withColumns({"_keep": F.lit(None).cast(pages.schema[key].dataType), "_n": F.lit(None).cast("long")})
    revisit = F.col("_n").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep"))
    told = met.unionByName(alone).select(F.col("_id").cast("string"), "_url", "_payload", revisit.alias("_revisit"), F.col("_keep").cast("string").alias("_keep"))
    records = told.mapInArrow(_members(date), "member binary").select(F.col("member").cast("string").alias("value"))
    per_file = max(1, archive_bytes * max(1, n) // max(1, total))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


# -- reading -----------------------------------------------------------------------------

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_DIGEST = re.compile(r"(sha1|sha256|md5):(\S+)$", re.I)


class Bad(ValueError):
    """What is wrong with the bytes at a place."""


def _differs(told: str | None, data: bytes) -> bool:
    """Whether a digest field contradicts ``data``. Unknown algorithms contradict nothing."""
    m = _DIGEST.match(told or "")
    if not m:
        return False
    own = hashlib.new(m[1].lower(), data)
    return m[2].upper() not in (base64.b32encode(own.digest()).decode(), base64.b32encode(own.digest()).decode().rstrip("="), own.hexdigest().upper())


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, Any]]:
    """End and fields of the record at ``at``. Raises Bad unless version, fields, length, end and digests hold."""
    if not _VERSION.match(data, at):
        raise Bad("no version line")
    head_end = data.find(b"\r\n\r\n", at, at + MAX_HEAD)
    if head_end < 0:
        raise Bad("no end of header")
    fields: dict[str, str] = {}
    last = ""
    for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Bad("a header line without a colon")
        last = name.strip().lower()
        fields[last] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Bad("a header without type, id or length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("no end of record where its length says")
    block = data[start:end]
    if _differs(fields.get("warc-block-digest"), block):
        raise Bad("a block that its digest contradicts")
    http = fields.get("content-type", "").lower().startswith("application/http")
    inner = block.find(b"\r\n\r\n") if http else -4
    payload = b"" if http and inner < 0 else block[inner + 4 :]
    digest, n_bytes = fields.get("warc-payload-digest"), len(payload)
    if fields["warc-type"] == "revisit":
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block[: max(inner, 0)] + b"\r")
        n_bytes = int(told[1]) if told else None
        digest = digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else None
    elif _differs(digest, payload):
        raise Bad("a payload that its digest contradicts")
    else:
        digest = digest_of(payload)
    strip = lambda x: None if x is None else x.strip("<>")
    return end + 4, {"type": fields["warc-type"], "record_id": strip(fields["warc-record-id"]), "refers_to": strip(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_bytes": n_bytes, "payload_digest": digest, "payload": payload}


def inflate(data: bytes, at: int) -> tuple[int, bytes]:
    """End and content of the gzip member at ``at``. Raises Bad unless it is whole, its checksum holds, and it begins a record or is empty."""
    z, out, place = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof and place < len(data):
            # a little first, as most places that only look like a member show it at once
            step = 512 if place == at else 1 << 16
            out += z.decompress(data[place : place + step])
            place += step
            if len(out) >= 5 and out[:5] != b"WARC/":
                raise Bad("a member that holds no record")
    except zlib.error as e:
        raise Bad("a broken member") from e
    if not z.eof:
        raise Bad("a member without an end")
    if out and out[:5] != b"WARC/":
        raise Bad("a member that holds no record")
    return min(place, len(data)) - len(z.unused_data), bytes(out)


def salvage(data: bytes, packed: bool = True) -> Iterator[tuple[int, int, dict[str, Any] | str]]:
    """(from, to, fields) of each valid record and (from, to, reason) of each gap, in order; they cover all bytes.

    At each place a record or (``packed``) a gzip member has to stand and to pass its checks.
    After a failure the next place is searched at which either does; what lies between is a
    gap with the reason of its first failure. A record that is read out of a member has the
    member's place, and so has a gap within it.
    """
    at, gap, reason = 0, None, ""
    after = {MAGIC: -1, b"WARC/1.": -1}
    while at < len(data):
        try:
            if packed and data.startswith(MAGIC, at):
                end, content = inflate(data, at)
                found = [(at, end, item) for _, _, item in salvage(content, packed=False)]
            else:
                end, fields = parse_record(data, at)
                found = [(at, end, fields)]
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            for mark in after:
                if after[mark] <= at:
                    place = data.find(mark, at + 1) if packed or mark != MAGIC else -1
                    after[mark] = place if place >= 0 else len(data)
            at = min(after.values())
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data), reason


READ = "archive string, at bigint, length bigint, gap string, type string, record_id string, refers_to string, target_uri string, date string, payload_bytes bigint, payload_digest string, payload binary"
_NAMES = ["type", "record_id", "refers_to", "target_uri", "date", "payload_bytes", "payload_digest", "payload"]


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for a, b, item in salvage(content.as_py()):
                    if isinstance(item, str):
                        rows.append((archive, a, b - a, item, *[None] * 8))
                    else:
                        size += len(item["payload"]) if payloads else 200
                        rows.append((archive, a, b - a, None, *(item[k] for k in _NAMES[:-1]), item["payload"] if payloads else None))
                    if size >= BATCH_BYTES:
                        yield batch_of()
                        rows.clear()
                        size = 0
        yield batch_of()

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """What the archives at ``path`` (a file, folder or glob; gzip members, plain records or both) hold, in rows of READ.

    A row with ``gap`` null is a record: its place, type, ids without brackets, url, date,
    payload and the payload's length and SHA-1 (base32); of a revisit length and digest are
    those of the payload that it stands for. A row with ``gap`` is a quarantined range of
    bytes and why it failed. ``payloads=False`` leaves payloads out. A file is read whole, and
    a damaged one costs its gaps only. An empty file gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(payloads), READ)


def records(read: DataFrame) -> DataFrame:
    return read.where("gap is null").drop("gap")


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: archive, at, length, gap."""
    return read.where("gap is not null").select("archive", "at", "length", "gap")


def page_of(uri: Column, kind: DataType) -> Column:
    """The key that a record id was made of."""
    return F.when(F.startswith(uri, F.lit(URN)) & (uri != URN), F.url_decode(F.replace(F.substring(uri, len(URN) + 1, 1 << 30), F.lit("+"), F.lit("%2B"))).cast(kind))


def archived_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages`` written and read back: key, payload_bytes, payload_digest, record_type, refers_to. The archives go when Python ends."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, key)
    kind = pages.schema[key].dataType
    found = records(read_archives(spark, path, payloads=False))
    return found.select(page_of(F.col("record_id"), kind).alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to"), kind).alias("refers_to"))


SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
bits AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM rows),
coded AS (
  SELECT page_id, payload_bytes, hex, list_transform(range(0, 40), lambda i: CAST('0x' || hex[i + 1] AS INT)) AS d FROM bits),
named AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
           (((d[(i * 5) // 4 + 1] * 16 + coalesce(d[(i * 5) // 4 + 2], 0)) >> (3 - (i * 5) % 4)) & 31), 1)), '') AS payload_digest
  FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM named WINDOW g AS (PARTITION BY payload_digest)
"""
