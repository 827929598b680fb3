"""CSV files read by many tasks each, with quoted line ends and row numbers.

A block is a split of a file, as Spark's text source deals it. Whether a block begins
inside quotes depends on all before it, so the first pass tells for each block what
it does to either beginning: where it ends if it begins outside or inside quotes, and how many
records end in it. These are functions on two states; composed in the order of blocks
they give every block's true beginning, and summed up the number of its first record.
The composition is a window over a row per block: what counts is the last block before
that ends the same way from both beginnings, and how many blocks since turn one into the other.
The second pass parses the blocks from their true beginnings. Records that lie in one
block are done there; pieces of the others meet by file and number.

Records are those of Python's csv module in its default dialect: a quote opens only at
the start of a field, a doubled one stands for itself, ``\\n``, ``\\r`` and ``\\r\\n`` end
records outside quotes, and blank lines are skipped. Bytes that aren't UTF-8 are left out.
An unclosed quote takes the rest of its file, without its last line end.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

#: Stands after a block's lines; a record of its own if the block ends outside quotes.
END = "\x00the end of these lines\x00"
BLOCK = "file string, start long"
RECORD = "file string, row long, fields array<string>"
PIECE = f"{RECORD}, start long, text string"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, start, seq, line): lines as ``\\n`` parts them; ``start`` is their block's, ``seq`` grows within it."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def physical(batch: list[bytes]) -> list[str]:
    """Lines with their ends, parted at single ``\\r`` too."""
    text = "".join(b.decode("utf-8", "ignore") + "\n" for b in batch)
    return list(io.StringIO(text, newline="")) if "\r" in text else text.splitlines(keepends=True) if text.isascii() and not any(c in text for c in "\x0b\x0c\x1c\x1d\x1e") else [x + "\n" for x in text.split("\n")[:-1]]


def records(rows: list[str]) -> tuple[list[list[str]], list[int], bool]:
    """The records that end in these lines, the lines that are over with each, and whether the last line ends outside quotes."""
    csv.field_size_limit(sys.maxsize)
    reader = csv.reader([*rows, END])
    found, ends = [], []
    for record in reader:
        found.append(record)
        ends.append(reader.line_num)
    done = found[-1] == [END]
    return found[:-1], ends[:-1], done


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Runs of lines of one block, with the first row's other columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        others = [c for c in batch.schema.names if c != "line"]
        names, starts = batch["file"].to_pylist(), batch["start"].to_pylist()
        held = batch["line"].cast(pa.binary()).to_pylist()
        edges = [0, *(i for i in range(1, len(held)) if starts[i] != starts[i - 1] or names[i] != names[i - 1]), len(held)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield {c: batch[c][a].as_py() for c in others}, held[a:b]


def _effects(batches):
    """For each run of lines: where it ends and how many records end in it, from outside and from inside quotes."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), *((f"{k}{s}", t) for s in (0, 1) for k, t in (("out", pa.int32()), ("n", pa.int64())))])
    for of, held in _runs(batches):
        rows, row = physical(held), [of["file"], of["start"], of["seq"]]
        for state in (0, 1):
            if state and not any('"' in r for r in rows):
                row += [1, 0]  # nothing here could end the field
                continue
            found, _, done = records(['"' + rows[0], *rows[1:]] if state else rows)
            row += [0 if done else 1, sum(map(bool, found))]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def _begins(effects: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Adds where each row begins (0 outside quotes, 1 inside) and the records that end before it, counted from the start of ``by``."""
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    turns = effects.withColumn("turns", F.sum(((F.col("out0") == 1) & (F.col("out1") == 0)).cast("int")).over(upto))
    fixed = F.last(F.when(F.col("out0") == F.col("out1"), F.struct("out0", "turns")), ignorenulls=True).over(before)
    since = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(F.col("fixed.turns"), F.lit(0))
    begun = turns.withColumn("fixed", fixed).withColumn("state", F.pmod(F.coalesce(F.col("fixed.out0"), F.lit(0)) + since, F.lit(2)))
    ended = F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1"))
    return begun.withColumn("base", F.coalesce(F.sum(ended).over(before), F.lit(0)))


def blocks(text: DataFrame) -> DataFrame:
    """(file, start, state, base, crossed): how each block begins, the number of its first record, and whether a record crosses one of its ends."""
    runs = text.mapInArrow(_effects, f"{BLOCK}, seq long, out0 int, n0 long, out1 int, n1 long")
    # A block's runs (one for each batch) make its own function, then blocks are composed.
    own = _compose(runs)
    begun = _begins(own, ["start"], ["file"])
    ends = F.when(F.col("state") == 0, F.col("out0")).otherwise(F.col("out1"))
    return begun.select("file", "start", F.col("state").cast("int").alias("state"), "base", ((F.col("state") == 1) | (ends == 1)).alias("crossed"))


def _compose(runs: DataFrame) -> DataFrame:
    """(file, start, out0, n0, out1, n1): the functions of a block's runs one after another."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "out0", "n0", "out1", "n1")))
    after = lambda state, s: F.when(state == 0, s["out0"]).otherwise(s["out1"])
    ended = lambda state, s: F.when(state == 0, s["n0"]).otherwise(s["n1"])
    out = runs.groupBy("file", "start").agg(steps.alias("steps"))
    for k in (0, 1):
        begin = F.struct(F.lit(k).alias("s"), F.lit(0).cast("long").alias("n"))
        out = out.withColumn(f"f{k}", F.aggregate("steps", begin, lambda x, s: F.struct(after(x["s"], s).alias("s"), (x["n"] + ended(x["s"], s)).alias("n"))))
    return out.select("file", "start", *[F.col(f"f{k}.{x}").alias(f"{name}{k}") for k in (0, 1) for x, name in (("s", "out"), ("n", "n"))])


def _parsed(batches, pieces: bool):
    """Whole records of each block; or, for ``pieces``, only the beginning and the end that belong to records across blocks."""
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("fields", pa.list_(pa.string())), ("start", pa.int64()), ("text", pa.string())])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    at, open_, inside, row = None, [], False, 0

    def rest():
        return [(at[0], row, None, at[1], "".join(open_))] if pieces and at and open_ else []

    for of, held in _runs(batches):
        out = []
        if at != (of["file"], of["start"]):
            out += rest()
            at, open_, inside, row = (of["file"], of["start"]), [], of["state"] == 1, of["base"]
        rows = physical(held)
        if (inside or open_) and not any('"' in r for r in rows):  # an open field goes on
            open_ += rows
        else:
            open_ += rows
            found, ends, done = records(['"' + open_[0], *open_[1:]] if inside else open_)
            if inside and found:
                out += [(at[0], row, None, at[1], "".join(open_[: ends[0]]))] if pieces else []
                row, found, inside, ends, gone = row + 1, found[1:], False, ends[1:], ends[0]
            else:
                gone = 0
            for record in filter(None, found):
                out += [] if pieces else [(at[0], row, record, at[1], None)]
                row += 1
            gone = ends[-1] if ends else gone
            open_ = [] if done else open_[gone:]
        if out:
            yield batch(out)
    if tail := rest():
        yield batch(tail)


def _whole(batches):
    """Records whose pieces have met."""
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("fields", pa.list_(pa.string()))])
    for batch in batches:
        fields = []
        for text in batch["text"].to_pylist():
            rows = list(io.StringIO(text, newline=""))
            found, _, done = records(rows)
            fields.append(found[0] if done else next(csv.reader([*rows[:-1], rows[-1].removesuffix("\n")])))
        yield pa.RecordBatch.from_arrays([batch["file"], batch["row"], pa.array(fields, schema.field("fields").type)], schema=schema)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, row, fields) of all records of CSV files, numbered from 0 in each file."""
    text = lines(spark, paths)
    known = blocks(text).persist()
    begun = lambda rows: text.join(F.broadcast(rows.select("file", "start", "state", "base")), ["file", "start"]).select("file", "start", "state", "base", "line")
    done = begun(known).mapInArrow(lambda b: _parsed(b, False), PIECE).select("file", "row", "fields")
    if known.where("crossed").isEmpty():
        return done
    pieces = begun(known.where("crossed")).mapInArrow(lambda b: _parsed(b, True), PIECE)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "")
    return done.union(pieces.groupBy("file", "row").agg(joined.alias("text")).mapInArrow(_whole, RECORD))
