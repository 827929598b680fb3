"""WARC archives: writing with revisit records, and reading in parallel from any place of a file.

Archives are plain files, written and read as lines by Spark's text writer and
reader, which carry them to and from any store. They are read once and cut, at line
ends, into pieces that are written to the shared folder with their place in the
file, so that nothing later depends on how the reader split its files. In each piece
a task lists candidates, lines that begin a record's header, and where each one's
successor would begin; chains inside a piece are followed by pointer jumping, which
leaves a place beyond it for each. Between pieces the same is done over a table of
entries, from the start of each file. Only records that this reaches are read, so a
magic line inside a payload is never taken for a record. A header may run over any
number of pieces, and so may a payload: such a record is put together from parts.
A file whose chain does not end where the file ends, or a record that leaves bytes
over, is an error. A record of 2 GB or more does not fit a row.

Nulls: a null payload is written as an empty one, a null url without its header,
a null id as ``null`` and read back as null. Of equal payloads the one with the
largest id is the response; rows that share this id are all responses. An empty
table gives empty archives. Other columns are not read, and may have any names.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .common import column, materialize, record_batch

#: A line end can't be mistaken wherever a block begins, other than the records' own end of two.
END = "\n"
#: Bytes after which a piece ends with the line.
PIECE = 1 << 20
_MAGIC = re.compile(rb"^WARC/1\.[01]\r\n", re.M)
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
_ID = re.compile(r"<urn:page:(-?\d+|null)>")
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, url string"


def _with_types(pages: DataFrame, least: int) -> DataFrame:
    """Adds each row's digest and, for a revisit, the id it refers to."""
    data = F.encode(F.coalesce("payload", F.lit("")), "UTF-8")
    rows = pages.withColumns({"digest": F.sha1(data), "n": F.length(data).cast("long")})
    firsts = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # Written, its size is known, and the planner broadcasts it or not by that.
    firsts = materialize(firsts.where("copies > 1").select("digest", "first"), "firsts")
    joined = rows.join(firsts, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 1000) -> None:
    """A record per row below ``out``; equal payloads of ``least`` bytes or more are stored once."""
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(payload_col).cast("string").alias("payload"), url.alias("url"))
    rows = _with_types(own, least)
    revisit, header = F.col("refers_to").isNotNull(), lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", urn("page_id")),
        F.coalesce(header("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")), F.lit("")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), header("WARC-Refers-To", urn("refers_to")), header("X-Payload-Length", F.col("n").cast("string")))).otherwise(""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: text/html\r\n"),
        header("Content-Length", F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.coalesce("payload", F.lit(""))),
        F.lit("\r\n\r"),  # and the line end
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(out)


def _pieces(batches, most: int):
    """Runs of whole lines of about ``most`` bytes; ``block`` is where the reader's split begins, ``seq`` counts its pieces."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
    at, seq, parts, held = None, 0, [], 0

    def piece():
        data = b"".join(parts)
        return record_batch(schema, [[at[0]], [at[1]], [seq], [len(data)], [data]])

    for batch in batches:
        for file, start, value in zip(*(column(batch, c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if at != (file, start) or held >= most:
                if parts:
                    yield piece()
                seq, at, parts, held = seq + 1 if at == (file, start) else 0, (file, start), [], 0
            parts += (value, b"\n")
            held += len(value) + 1
    if parts:
        yield piece()


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """Where the payload of the record at ``at`` begins and how long it is; None if the header isn't whole or sound."""
    end = data.find(b"\r\n\r\n", at)
    found = _LENGTH.search(data, at, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else None


def jump(next_: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each chain leaves the piece, by pointer jumping, -1 where it breaks; and the last of ``places`` on it.

    ``next_`` has the successor of each of the sorted ``places``; a place that is
    its own successor ends a chain.
    """
    n = len(places)
    where = np.searchsorted(places, next_)
    inside = (next_ >= 0) & (next_ < size)
    hit = inside & (where < n) & (places[np.minimum(where, n - 1)] == next_)
    exits = np.where((next_ >= size) | (next_ == places), next_, -1)
    # A chain that has left or broken stays where its last record is.
    to = np.where(hit, where, np.arange(n))
    while True:
        further = to[to]
        if (further == to).all():
            return exits[to], places[to]
        to = further


def _told_length(data: bytes, at: int, end: int) -> int | None:
    found = _LENGTH.search(data, at, end)
    return int(found[1]) if found else None


_FOUND = "file string, block long, seq long, at long, exit long, last long, length long"


def _candidates(batches):
    """A piece's candidates. One whose header the piece's end cuts off is its own exit, with the length told so far.

    A row with ``at`` -1 tells of a header that began before: where it ends in this piece (``exit``), if it does, and the length told before that.
    """
    schema = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("block", "seq", "at", "exit", "last", "length"))])
    for batch in batches:
        for file, block, seq, data in zip(*(column(batch, c) for c in ("file", "block", "seq", "data")), strict=True):
            data, places, next_, told = data.as_py(), [], [], []
            for m in _MAGIC.finditer(data):
                p, head = m.start(), _header(data, m.start())
                cut = head is None and data.find(b"\n\r\n", p) < 0
                places.append(p)
                next_.append(head[0] + head[1] + 4 if head else p if cut else -1)
                told.append(_told_length(data, p, len(data)) if cut else None)
            # The piece begins with a line, so an empty line, which ends a header, is at its start or after another.
            end = 2 if data.startswith(b"\r\n") else found + 3 if (found := data.find(b"\n\r\n")) >= 0 else None
            exits, last = jump(np.array(next_, np.int64), np.array(places, np.int64), len(data)) if places else (np.zeros(0, np.int64),) * 2
            n = len(places) + 1
            yield record_batch(schema, [[file.as_py()] * n, [block.as_py()] * n, [seq.as_py()] * n, [-1, *places], [end, *exits.tolist()], [-1, *last.tolist()], [_told_length(data, 0, len(data) if end is None else end), *told]])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", END).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _reached(places: DataFrame, most_rounds: int = 50) -> DataFrame:
    """The places (file, at) on the chain from the start of each file; ``places`` has (file, at, exit)."""
    reach = places.where("at = 0").select("file", "at")
    jumps = places.select("file", "at", F.col("exit").alias("to"))
    count = reach.count()
    for _ in range(most_rounds):
        ahead = reach.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = materialize(reach.union(ahead).distinct(), "reached")
        if (now := reach.count()) == count:
            return reach
        count = now
        far = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = materialize(jumps.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("far", "to").alias("to")), "jumps")
    raise RuntimeError("a file has more blocks than rounds of pointer jumping allow")


def plan_pieces(pieces: DataFrame) -> DataFrame:
    """Per piece, counted from its start: where its first record begins (``entry``), where the records end that are whole in it (``stop``); and the places in the file where the records end that begin before it (``until``) and in it (``next``).

    Raises if a file's chain does not end where the file does.
    """
    found = materialize(pieces.select("file", "block", "seq", "data").mapInArrow(_candidates, _FOUND), "candidates")
    order = W.partitionBy("file").orderBy("block", "seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    places = pieces.select("file", "block", "seq", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(W.partitionBy("file")).alias("total"))
    places = materialize(places, "places")
    known = found.join(places, ["file", "block", "seq"])
    # A cut header ends in the first later piece that has an end, with the first length told on the way.
    later, here = order.rowsBetween(1, W.unboundedFollowing), lambda c: F.when(F.col(c).isNotNull(), F.struct("base", F.col(c).alias("x")))
    ends = known.where("at < 0").select("file", "block", "seq", F.first(here("exit"), ignorenulls=True).over(later).alias("end"), F.first(here("length"), ignorenulls=True).over(later).alias("told"))
    cut = known.where("at >= 0 and exit = at").join(ends, ["file", "block", "seq"])
    length = F.coalesce("length", F.when(F.col("told.base") <= F.col("end.base"), F.col("told.x")))
    cut = cut.select("file", "block", "seq", (F.col("base") + F.col("at")).alias("at"), (F.col("end.base") + F.col("end.x") + length + 4).alias("exit"), (F.col("base") + F.col("at")).alias("last"), F.lit(True).alias("cut"))
    own = known.where("at >= 0 and exit >= 0 and exit <> at").select("file", "block", "seq", *[(F.col("base") + F.col(c)).alias(c) for c in ("at", "exit", "last")], F.lit(False).alias("cut"))
    own = own.unionByName(cut.where("exit is not null"))
    aims = own.select("file", F.col("exit").alias("at")).distinct()
    entries = materialize(own.where("at = 0").unionByName(own.where("at > 0").join(aims, ["file", "at"], "left_semi")), "entries")
    reached = materialize(entries.join(_reached(entries), ["file", "at"], "left_semi"), "chain")
    files = places.select("file", "total").distinct()
    open_ = files.join(reached.select("file", F.col("exit").alias("total")), ["file", "total"], "left_anti").first()
    if open_:
        raise ValueError(f"the records of {open_['file']} do not end where it ends")
    # In a piece, the chain from its first record leads to the last one, whose header may be cut.
    first = reached.groupBy("file", "block", "seq").agg(F.min("at").alias("entry"), F.min_by(F.struct("exit", "last"), "at").alias("x"), F.max("cut").alias("ends_cut")).select("file", "block", "seq", "entry", "x.exit", "x.last", "ends_cut")
    planned = places.join(first, ["file", "block", "seq"], "left").withColumn("until", F.coalesce(F.first("entry", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)), F.col("total")))
    planned = planned.withColumn("next", F.coalesce(F.lead("until").over(order), F.col("total")))
    spans = F.col("ends_cut") | (F.col("exit") > F.col("base") + F.col("size"))
    stop = F.when(spans, F.col("last") - F.col("base")).otherwise(F.col("size"))
    return planned.select("file", "block", "seq", "base", "size", (F.col("entry") - F.col("base")).cast("int").alias("entry"), F.when(F.col("entry").isNotNull(), stop).cast("int").alias("stop"), "until", "next")


def _parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """A record's fields, and where it ends; its payload is checked against its digest where it carries one."""
    if not (found := _header(data, at)):
        raise ValueError("a record has no whole header")
    begin, size = found
    payload = data[begin : begin + size]
    if data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    head = dict(line.split(": ", 1) for line in data[at : begin - 4].decode().split("\r\n")[1:])
    revisit = head["WARC-Type"] == "revisit"
    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and hashlib.sha1(payload).hexdigest() != told:
        raise ValueError("a payload does not have its digest")
    id_of = lambda name: int(m[1]) if (m := _ID.search(head.get(name, ""))) and m[1] != "null" else None
    fields = id_of("WARC-Record-ID"), head["WARC-Type"], id_of("WARC-Refers-To"), int(head["X-Payload-Length"]) if revisit else size, told, payload, head.get("WARC-Target-URI")
    return fields, begin + size + 4


_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("url", pa.string())])


def _some(rows: list[tuple]):
    return record_batch(_SCHEMA, list(zip(*rows, strict=True)) if rows else [[]] * 7)


def _records(batches):
    """The records that are whole in a piece, from ``entry`` to ``stop``."""
    for batch in batches:
        for data, at, stop in zip(*(column(batch, c) for c in ("data", "entry", "stop")), strict=True):
            data, at, stop, rows, held = data.as_py(), at.as_py(), stop.as_py(), [], 0
            while at < stop:
                row, at = _parse(data, at)
                rows.append(row)
                held += len(row[5])
                if len(rows) == 256 or held > PIECE:
                    yield _some(rows)
                    rows, held = [], 0
            if at != stop:
                raise ValueError("records do not end where the next begins")
            if rows:
                yield _some(rows)


def _joined(batches):
    for batch in batches:
        for parts in column(batch, "parts"):
            data = b"".join(p["data"] for p in parts.as_py())
            row, end = _parse(data)
            if end != len(data):
                raise ValueError("a record leaves bytes over")
            yield _some([row])


def read_warc(spark: SparkSession, path: str, piece_bytes: int = PIECE) -> DataFrame:
    """The records of all archives below ``path``: ``RECORD``."""
    pieces = materialize(_lines(spark, path).mapInArrow(partial(_pieces, most=piece_bytes), "file string, block long, seq long, size long, data binary"), "pieces", "zstd")
    plan = materialize(plan_pieces(pieces), "plan")
    planned = pieces.select("file", "block", "seq", "data").join(plan, ["file", "block", "seq"])
    whole = planned.where("entry < stop").select("data", "entry", "stop").mapInArrow(_records, RECORD)
    head = F.struct(F.col("until"), F.col("base").alias("begin"), F.expr("substring(data, 1, coalesce(entry, size))").alias("data"))
    tail = F.struct(F.col("next").alias("until"), (F.col("base") + F.col("stop")).alias("begin"), F.expr("substring(data, stop + 1)").alias("data"))
    parts = planned.where("entry is null or entry > 0 or stop < size").select("file", F.explode(F.array(head, tail)).alias("p")).select("file", "p.*").where("length(data) > 0")
    over = parts.groupBy("file", "until").agg(F.array_sort(F.collect_list(F.struct("begin", "data"))).alias("parts"))
    return whole.unionByName(over.select("parts").mapInArrow(_joined, RECORD))
