"""Chat formatting: turns and typed content parts into one template, with a loss mask.

A turn is written as ``<|im_start|>role``, a line end, its content and
``<|im_end|>`` with a line end. In roles and texts a backslash is doubled and
``<|`` gets a backslash between its characters, so no control string can stand
there and all can be undone. A visitor flattens typed parts in order: text as it
is, others as a numbered placeholder, for which it records the reference and how
many tokens the placeholder will take once expanded.

Placeholders are numbered through a conversation, in the order of its turns. A part
of an unknown kind gets the placeholder ``other`` and its own kind on record, with
no tokens; a null part is as an empty text.

The output has a row per turn, not per conversation, so a conversation of any
length is written and read in a stream.

Nulls: a null text or role is as an empty one; rows with a null conversation id are
one conversation; a null turn comes first. Turns that tie are ordered by their
formatted text, and numbered by role and content. An empty table gives no rows.
Very long texts are formatted whole. Other columns are not read, and may have any
names.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import partial

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType

from .common import column, record_batch

START, STOP = "<|im_start|>", "<|im_end|>\n"
_ESCAPED = re.compile(r"\\([\\|n])")
_UNDO = {"\\": "\\", "|": "|", "n": "\n"}
#: Tokens that attachments expand to: per image patch side, per second of audio, per page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
KINDS = ("text", "image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ROW = "conv_id long, turn long, segment string, mask_start long, mask_length long, attachments array<struct<ordinal:int,kind:string,ref:string,tokens:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNDO[m[1]], text) if "\\" in text else text


class Flatten:
    """Visits the parts of a turn in order."""

    def __init__(self, first: int = 1) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.first = first

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in KINDS else "visit_other")(part or {})

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or PATCH) / PATCH) * math.ceil((part.get("height") or PATCH) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        ordinal = self.first + len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "kind": part["type"] if kind == "other" else kind, "ref": part.get("ref"), "tokens": tokens})
        self.out.append(f"<|{kind}_{ordinal}|>")


def _format(batches, trained: str):
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("mask_start", pa.int64()), ("mask_length", pa.int64()), ("attachments", pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])
    for batch in batches:
        segments, starts, lengths, attached = [], [], [], []
        for role, content, first in zip(column(batch, "role").to_pylist(), column(batch, "content").to_pylist(), column(batch, "first").to_pylist(), strict=True):
            visitor = Flatten(first)
            for part in content if isinstance(content, list) else [{"type": "text", "text": content}]:
                visitor.visit(part)
            body, head = "".join(visitor.out), START + escape(role or "").replace("\n", "\\n") + "\n"
            segments.append(head + body + STOP)
            starts.append(len(head))
            lengths.append(len(body) if role == trained else 0)
            attached.append(visitor.attachments)
        yield record_batch(schema, [column(batch, "conv_id"), column(batch, "turn"), segments, starts, lengths, attached])


def format_chat(turns: DataFrame, trained: str = "assistant", content_col: str = "text") -> DataFrame:
    """A formatted segment per turn: ``ROW``. ``content_col`` is a text or an array of parts (``PART``).

    The mask is the content of turns whose role is ``trained``, in code points of the segment.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col(content_col).alias("content"), F.lit(1).alias("first"))
    if isinstance(turns.schema[content_col].dataType, ArrayType):
        # What stands in earlier turns of the conversation; texts alone need no shuffle.
        some = F.coalesce(F.size(F.filter("content", lambda p: F.coalesce(p["type"], F.lit("text")) != "text")), F.lit(0))
        before = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64(F.to_json("content"))).rowsBetween(W.unboundedPreceding, -1)
        attached = own.where(some > 0)
        counted = attached.withColumn("first", (1 + F.coalesce(F.sum(some).over(before), F.lit(0))).cast("int"))
        own = own.where(some <= 0).unionByName(counted)
    return own.mapInArrow(partial(_format, trained=trained), ROW)


def _parse(segment: str) -> tuple[str, str]:
    head, mark, rest = segment.partition("\n")
    if not (head.startswith(START) and mark and rest.endswith(STOP)):
        raise ValueError("not a turn of this template")
    return unescape(head[len(START) :]), unescape(rest[: -len(STOP)])


class _Digest:
    def __init__(self, conv_id):
        self.row = [conv_id, 0, "", 0, "", 0]
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, length: int) -> None:
        role, text = _parse(segment)
        self.row[1] += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        if length:
            masked = unescape(segment[start : start + length])
            self.row[3] += len(masked)
            self.loss.update(masked.encode())
        self.row[5] += len(segment)

    def end(self) -> list:
        self.row[2], self.row[4] = self.turns.hexdigest(), self.loss.hexdigest()
        return self.row


def _digests(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    open_, rows = None, []
    for batch in batches:
        for conv_id, *segment in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "segment", "mask_start", "mask_length")), strict=True):
            if open_ is None or conv_id != open_.row[0]:
                if open_:
                    rows.append(open_.end())
                open_ = _Digest(conv_id)
            open_.add(*segment)
        if rows:
            yield record_batch(schema, list(zip(*rows, strict=True)))
            rows = []
    if open_:
        yield record_batch(schema, [[x] for x in open_.end()])


def read_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its segments in order: turns, text under the mask, and digests of both."""
    own = formatted.select("conv_id", "turn", "segment", "mask_start", "mask_length")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
