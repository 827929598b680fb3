"""SimHash near-duplicates: fingerprints of word shingles, linked by vantage-point trees.

Two fingerprints that differ in at most ``radius`` bits differ in at most
``radius // 2`` bits in one of their 32-bit halves. So each half gets a tree: a
node holds a vantage point and a distance, and by the triangle inequality a
fingerprint needs to visit a side only if its own distance lies within the
half's radius of the boundary. The top of the trees comes from a bounded sample
and only decides how evenly the work is dealt; its leaves are the shards.
Fingerprints near a boundary also visit the shard on the inner side. In a shard
the tree goes on, down to blocks that are compared bit by bit over the whole
fingerprint, and links come out as stars, at most one per fingerprint.

Nulls: null, empty and blank texts have the fingerprint zero. Copies meet in one
fingerprint before any comparison, so groups of any size cost one row. A null
id counts as no id: a component's id is the smallest that isn't null. Other
columns are not read, kept by ``keep_one``, and may have any names. Of rows with the
same id and text one stays. Texts of any length are hashed whole, in runs of
shingles. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import bytes_of, column, fresh, give_back, lower_ascii, materialize, numbers_of, record_batch, slices
from .graph import components

SEED = 42
#: Fingerprints that the top trees are grown from, and how many a shard should get.
SAMPLE, SHARD = 1 << 16, 4096
#: Pairs that are compared in one block.
BLOCK = 1 << 21


def shingles(text: bytes | None, width: int = 3) -> list[bytes]:
    words = text.translate(lower_ascii()).split() if text else []
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """A bit is set if more than half of the shingles' XXH64 hashes have it."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, width)
    if not parts:
        return 0
    counts, n = np.zeros(64, np.int64), len(parts)
    for k in range(0, n, 1 << 16):
        some = parts[k : k + (1 << 16)]
        h = np.fromiter(map(xxh64_intdigest, some, repeat(SEED)), np.uint64, len(some))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])
    for batch in batches:
        for some in slices(batch, "text", 4 << 20):
            fps = np.array([fingerprint(t, width) for t in bytes_of(some, "text")], np.uint64)
            yield record_batch(schema, [column(some, "doc_id"), fps.view(np.int64), column(some, "text_hash")])
    give_back()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64(F.col("doc_id").isNull(), "text"))
    return own.mapInArrow(partial(_fingerprints, width=width), "doc_id long, fp long, text_hash long")


def _half(fps: np.ndarray, half: int) -> np.ndarray:
    """Half 0 or 1 of each fingerprint, or for 2 the whole."""
    return fps if half == 2 else (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that halve ``x`` well, of a few tried."""
    best = None
    for v in x[rng.integers(0, len(x), 6)]:
        d = np.bitwise_count(x ^ v)
        counts = np.cumsum(np.bincount(d, minlength=66))
        for mu in {int(np.searchsorted(counts, len(x) // 2)), max(0, int(np.searchsorted(counts, len(x) // 2)) - 1)}:
            inside = int(counts[mu])
            cost = max(inside, len(x) - inside) + (int(counts[min(65, mu + 2)]) - inside)
            if 0 < inside < len(x) and (best is None or cost < best[0]):
                best = (cost, v, mu)
    return best and best[1:]


class Tree:
    """The top of a tree over one half; leaves are numbered.

    Where all fingerprints of a node have the same half, it is split by the whole
    fingerprint, with the whole radius.
    """

    def __init__(self, sample: np.ndarray, half: int, depth: int, seed: int = 5):
        self.half, self.leaves = half, 0
        rng = np.random.default_rng(seed + half)

        def grow(x: np.ndarray, part: int, depth: int):
            at = _split(_half(x, part), rng) if depth and len(x) > 16 else None
            if at is None and depth and len(x) > 16 and part < 2:
                return grow(x, 2, depth)
            if at is None:
                self.leaves += 1
                return self.leaves - 1
            inside = np.bitwise_count(_half(x, part) ^ at[0]) <= at[1]
            return (*at, part, grow(x[inside], part, depth - 1), grow(x[~inside], part, depth - 1))

        self.root = grow(sample, half, depth)

    def deal(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, leaf and whether it is the row's home, for every leaf that a row lives in or visits."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def go(node, rows: np.ndarray, home: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node), home))
                return
            v, mu, part, low, high = node
            near = radius if part == 2 else radius // 2
            d = np.bitwise_count(_half(fps[rows], part) ^ v).astype(np.int64)
            inside = d <= mu
            # A row that lives outside visits the inside, never the other way round: each pair meets once.
            into = (home & inside) | (d - near <= mu) & ~(home & inside)
            go(low, rows[into], (home & inside)[into])
            out_of = (home & ~inside) | ~home & (d + near > mu)
            go(high, rows[out_of], home[out_of])

        go(self.root, np.arange(len(fps)), np.ones(len(fps), bool))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


class Stars:
    """Sets of linked rows, each under its smallest row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label[:] = label[label]


def search(fps: np.ndarray, home: np.ndarray, half: int, radius: int, stars: Stars, seed: int = 3) -> None:
    """Link all pairs within ``radius`` bits of which one row is at home and the half is near enough."""
    rng = np.random.default_rng(seed)

    def block(h: np.ndarray, v: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(h) + len(v)))
        for k in range(0, len(h), step):
            rows = h[k : k + step]
            for others, own in ((h[k:], True), (v, False)):
                if len(others):
                    i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[others][None, :]) <= radius)
                    far = i != j if own else slice(None)
                    stars.link(rows[i[far]], others[j[far]])

    todo = [(np.flatnonzero(home), np.flatnonzero(~home), half)]
    while todo:
        h, v, part = todo.pop()
        near = radius // 2 if part < 2 else radius
        if not len(h):
            continue
        if len(h) <= 256 or len(h) * (len(h) + len(v)) <= BLOCK // 4:
            block(h, v)
            continue
        x = _half(fps, part)
        at = _split(x[h], rng)
        if at is None:  # one value only in this half: the rest of the bits tell them apart
            if part < 2:
                todo.append((h, v, 2))
            else:
                block(h, v)
            continue
        dh, dv = (np.bitwise_count(x[k] ^ at[0]).astype(np.int64) for k in (h, v))
        inside = dh <= at[1]
        todo.append((h[inside], np.append(h[~inside & (dh - near <= at[1])], v[dv - near <= at[1]]), part))
        todo.append((h[~inside], v[dv + near > at[1]], part))


def _deal(batches, trees, radius: int):
    schema = pa.schema([("shard", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])
    for batch in batches:
        fps = numbers_of(batch, "fp").view(np.uint64)
        for tree in trees.value:
            rows, leaf, home = tree.deal(fps, radius)
            yield record_batch(schema, [2 * leaf + tree.half, fps[rows].view(np.int64), home])


def _links(radius: int):
    def links(shard: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        fps, home = shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy().astype(bool)
        order = np.argsort(fps.view(np.int64))  # a star's centre is then what components take as root
        fps, home = fps[order], home[order]
        stars = Stars(len(fps))
        search(fps, home, shard["shard"][0].as_py() % 2, radius, stars)
        far = np.flatnonzero(stars.label != np.arange(len(fps)))
        return pa.table([fps[far].view(np.int64), fps[stars.label[far]].view(np.int64)], schema=schema)

    return links


def link(distinct: DataFrame, radius: int = 3, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all pairs within ``radius`` bits into the same sets.

    ``distinct`` has a column ``fp`` without repeats. The sample is the first ones
    whose hash lies below a bound; only it reaches the driver.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    below = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(n, 1))))
    some = sorted(r["fp"] for r in distinct.where(below).select("fp").collect()) if depth else []
    some = np.array(some, np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([Tree(some, half, depth) for half in (0, 1)])
    dealt = distinct.select("fp").mapInArrow(partial(_deal, trees=trees, radius=radius), "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint (16 hex digits), and the smallest id it reaches over links; also what picks one row of a group."""
    own = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = materialize(own.groupBy("fp").agg(first), "distinct")
    roots = components(link(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("of"))
    known = rooted.select("fp", "root").join(groups, "root").select("fp", "of")
    return own.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("of.doc_id").alias("component_id"), "text_hash", F.col("of.text_hash").alias("first_hash"))


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each group, all columns."""
    found = near_duplicates(docs, radius, width, id_col, text_col)
    keys = fresh(docs, "kept_id", "kept_hash")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))).select(F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("text_hash").alias(keys[1])).distinct()
    own = F.col(id_col).cast("long")
    docs = docs.withColumns({keys[0]: F.coalesce(own, F.lit(0)), keys[1]: F.xxhash64(own.isNull(), F.col(text_col).cast("string"))})
    # Both steps have the same keys, so the texts are shuffled once.
    return docs.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
