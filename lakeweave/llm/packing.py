"""Packing of tokenised documents into sequences: large-item matching, then best fit.

Only how many pieces there are of each length decides where pieces go, and there
are no more lengths than tokens in a sequence. So the histogram goes to the
driver, which plans for whole runs of like pieces at once, over all the data:
pieces above a third of the capacity are matched greedily, at most two in a
sequence, largest with the largest that fits; smaller ones go, by falling length,
into the smallest gap that holds them. Each piece then finds its place by its
rank among those of its length.

Nulls: a null text is as an empty one, with the end id only. Repeated ids and
rows are packed each by itself. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from .common import column, exclusive, materialize, numbers_of, record_batch, slices
from .tokens import encoder

#: Units whose ids a worker keeps, at about 250 bytes each.
MAX_UNITS = 700_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def _pieces(batches, path: str, end_id: int, capacity: int, max_units: int, keep_units: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "part", "rank"))])
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            ids, sizes = encoder(path, max_units).encode(column(some, "text"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            cuts = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(owner)) - np.repeat(exclusive(cuts), cuts)
            start = piece * capacity
            length = np.minimum(capacity, sizes[owner] - start)
            raw = memoryview(ids.astype("<u4")).cast("B")
            at = exclusive(sizes)[owner] + start
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            row = length[order]
            first = np.append(True, row[1:] != row[:-1])
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield record_batch(schema, [column(some, "doc_id").take(pa.array(owner)), piece.astype(np.int32), start, length, crcs, np.full(len(owner), part), rank])
    if not keep_units:
        encoder(path, max_units).forget()


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS, keep_units: bool = True) -> DataFrame:
    """The pieces of each document, with the rank of each among those of its length in its task."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partial(_pieces, path=tokenizer, end_id=end_id, capacity=capacity, max_units=max_units, keep_units=keep_units), PIECE)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go, and how many sequences there are.

    Rows of (length, first rank, pieces, first sequence, first offset, pieces per
    sequence), sorted; the pieces of a row fill one sequence after another.
    """
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    large, rows, used, taken = capacity // 3 + 1, [], 0, [0] * (capacity + 1)
    gaps: dict[int, list[tuple[int, int]]] = {}

    def place(n: int, pieces: int, first: int, offset: int, each: int) -> None:
        rows.append((n, taken[n], pieces, first, offset, each))
        taken[n] += pieces
        left[n] -= pieces

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    for n in range(capacity, large - 1, -1):
        m = min(n, capacity - n)
        while left[n]:
            while m >= large and (not left[m] or m == n and left[n] < 2):
                m -= 1
            if m < large:
                k = left[n]
                free(capacity - n, used, k)
                place(n, k, used, 0, 1)
            elif m == n:
                k = left[n] // 2
                free(capacity - 2 * n, used, k)
                place(n, 2 * k, used, 0, 2)
            else:
                k = min(left[n], left[m])
                free(capacity - n - m, used, k)
                place(n, k, used, 0, 1)
                place(m, k, used, n, 1)
            used += k
    for n in range(min(large - 1, capacity), 0, -1):
        gap = n
        while left[n]:
            while gap < capacity and gap not in gaps:
                gap += 1
            if gap >= capacity:
                first, count, gap = used, -(-left[n] // (capacity // n)), capacity
                used += count
            else:
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                place(n, full * each, first, capacity - gap, each)
                free(gap - each * n, first, full)
            if full < count and left[n]:
                rest = left[n]
                place(n, rest, first + full, capacity - gap, rest)
                free(gap - rest * n, first + full, 1)
                full += 1
            if gap < capacity:
                free(gap, first + full, count - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 6), used


def _placed(batches, rows):
    rows = rows.value
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])
    # Ranks of a length follow on; with the length's own base they make one sorted key.
    sizes = np.zeros(int(rows[:, 0].max(initial=0)) + 2, np.int64)
    np.add.at(sizes, rows[:, 0], rows[:, 2])
    base = exclusive(sizes)
    keys = base[rows[:, 0]] + rows[:, 1]
    for batch in batches:
        length, rank = numbers_of(batch, "length"), numbers_of(batch, "rank")
        key = base[length] + rank
        row = rows[np.searchsorted(keys, key, "right") - 1]
        k = rank - row[:, 1]
        yield record_batch(schema, [*(column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), row[:, 3] + k // row[:, 5], row[:, 4] + k % row[:, 5] * length])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", max_units: int = MAX_UNITS, keep_units: bool = True) -> DataFrame:
    """One row per piece with its sequence and its place there.

    The pieces are written to the shared folder once, so that ranks stay as they
    are when an executor is lost. What reaches the driver is a row per length.
    Without ``keep_units`` a worker's memory for units is given back after each task.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, tokenizer, end_id, capacity, id_col, text_col, max_units, keep_units), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(totals, capacity)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    return ranked.mapInArrow(partial(_placed, rows=spark.sparkContext.broadcast(rows)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
