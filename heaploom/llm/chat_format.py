"""Chat formatting at the level of tokens.

Every turn is encoded by itself and placed between reserved ids that no text can encode
to, so a template's marks never depend on what stands beside them. Prefix sums over the
lengths of the segments give each turn's place and with it the loss mask. In the written
form the marks are control strings; where a text holds such a string, a backslash behind
its first character breaks it, and backslashes of the text are doubled, so that texts
read back as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heaploom.llm.common import bounded_batches

#: Marks of the template, in the order of their reserved ids.
MARKS = ("<|begin|>", "<|turn|>", "<|body|>", "<|end|>")
#: Strings that are escaped in texts: the marks, and those of other common templates.
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
_CONTROL_AT = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(\\?)")
FORMAT_SCHEMA = "conv_id {kind}, n_turns bigint, ids array<int>, turn_at array<int>, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _CONTROL_AT.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class ChatCodec:
    """Encodes turns with a byte-level vocabulary and reserved ids above it; decoding is exact."""

    def __init__(self, ranks_file: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begin, self.turn, self.body, self.end = (max(ranks.values()) + 1 + i for i in range(len(MARKS)))

    def segment(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(escape(text))

    def text(self, ids: list[int]) -> str:
        return unescape(self.enc.decode_bytes(ids).decode())

    def written(self, ids: Iterable[int]) -> str:
        """The formatted document as a string."""
        out, part = [], []
        for i in ids:
            if i < self.begin:
                part.append(i)
                continue
            out += [self.enc.decode_bytes(part).decode(), MARKS[i - self.begin]]
            part = []
        return "".join([*out, self.enc.decode_bytes(part).decode()])

    def turn_ids(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The ids of a turn, and where in them its text starts and ends."""
        head = [self.turn, *self.segment(role), self.body]
        body = self.segment(text)
        return [*head, *body, self.end], len(head), len(head) + len(body)

    def turns(self, ids: list[int]) -> Iterator[tuple[str, str, int, int]]:
        """Role and text of each turn of a formatted document, and the place of its text."""
        at = 0
        while at < len(ids):
            if ids[at] != self.turn:
                at += 1
                continue
            body = ids.index(self.body, at)
            end = ids.index(self.end, body)
            yield self.text(ids[at + 1 : body]), self.text(ids[body + 1 : end]), body + 1, end
            at = end + 1


def encode_turns(turns: DataFrame, ranks_file: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, ids, body_start, body_end, n_ids, loss.

    Null roles and texts count as empty. No shuffle; texts are encoded one by one where they are.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChatCodec(ranks_file)
        for b in batches:
            roles, texts = ([x or "" for x in c.to_pylist()] for c in (b.column(2), b.column(3)))
            rows = [codec.turn_ids(r, t) for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([len(r[0]) for r in rows], pa.int32()), pa.array([r in trained for r in roles], pa.bool_())],
                names=["conv_id", "turn", "role", "text", "ids", "body_start", "body_end", "n_ids", "loss"],
            )

    kinds = dict(turns.dtypes)
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(
        encoded, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, body_start int, body_end int, n_ids int, loss boolean"
    )


def _in_order(encoded: DataFrame) -> DataFrame:
    return encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(turns: DataFrame, ranks_file: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, ids, turn_at, loss_spans.

    ``ids`` is the document: a begin mark, then per turn a turn mark, the role, a body
    mark, the text and an end mark. ``turn_at`` holds where each turn starts, the prefix
    sums of the turns' lengths; ``loss_spans`` the places of trained texts in ``ids``.
    Turns go by turn number, null first, ties by role and text; repeated rows are turns
    of their own. A null conv_id is a conversation. Empty tables give no rows; other
    columns are ignored. A conversation is one row of the result and has to fit a task.
    """
    bounded_batches(turns)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = ChatCodec(ranks_file).begin
        names = ["conv_id", "n_turns", "ids", "turn_at", "loss_spans"]
        now: dict | None = None

        def row(d: dict) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array([d[k]], t) for k, t in zip(names, kinds)], names=names)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, ids, lo, hi, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "body_start", "body_end", "loss"))):
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        yield row(now)
                    now = {"conv_id": conv, "n_turns": 0, "ids": [begin], "turn_at": [], "loss_spans": []}
                at = len(now["ids"])
                now["n_turns"] += 1
                now["turn_at"].append(at)
                now["ids"] += ids
                if loss:
                    now["loss_spans"].append({"start": at + lo, "end": at + hi})
        if now is not None:
            yield row(now)

    encoded = _in_order(encode_turns(turns, ranks_file, trained))
    return encoded.mapInArrow(joined, FORMAT_SCHEMA.format(kind=dict(encoded.dtypes)["conv_id"]))


def read_back(formatted: DataFrame, ranks_file: str) -> DataFrame:
    """Digests of what a formatted table says, decoded from its ids: one row per conversation."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChatCodec(ranks_file)
        for b in batches:
            out = []
            for ids, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                said, learnt, n = hashlib.sha256(), hashlib.sha256(), 0
                masked = {(s["start"], s["end"]) for s in spans}
                turns = 0
                for role, text, lo, hi in codec.turns(ids):
                    turns += 1
                    said.update(f"{role}\n{text}\n".encode())
                    if (lo, hi) in masked:
                        under = codec.text(ids[lo:hi])
                        learnt.update(under.encode())
                        n += len(under)
                out.append((turns, said.hexdigest(), n, learnt.hexdigest(), len(codec.written(ids))))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "ids", "loss_spans").mapInArrow(decoded, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def contract_rows(conversations: DataFrame) -> DataFrame:
    """The table with conversation -1, whose texts consist of control strings."""
    spark = conversations.sparkSession
    kinds = dict(conversations.dtypes)
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
