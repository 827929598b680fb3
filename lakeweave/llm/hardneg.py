"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x of integers gets one more component, the root of (largest norm - its norm),
and an anchor q gets 0 there. Then the squared distance is |q|^2 + largest - 2 q.x, so
higher scores are nearer, and a window of scores is an annulus of distances. The top of
a tree, grown from a bounded sample, deals rows to leaves; large leaves are cut into
shards of about ``SHARD`` rows by a hash. An anchor visits those leaves that its bound
(the annulus, or the nearest same-label rows found so far) reaches by the triangle
inequality, in blocks of at most about ``QUERIES`` anchors a shard. In a shard the tree
goes on down to buckets; each anchor takes its buckets nearest first and stops when the
next one lies beyond its k-th row or beyond the annulus. Distances only decide what is
looked at, with some slack; scores are exact integers and decide what is returned.

Rows with the same vector and label differ in their ids only, so of such a group the
smallest ids are all that can be returned; as many are kept before anything is dealt,
and anchors with the same vector and label are searched once.

Nulls: rows with a null id, label or vector, or with a null or non-finite component take
no part; nor do those whose scaled components have squares that sum to 2^60 or more, as
scores must fit in a long. Rows of different lengths are taken to end in zeros. An exactly
repeated row counts once; of rows with the same id that differ, the one with the smallest
label, then vector. An empty vector scores 0 with all. With fewer rows than asked for all
are returned, with none no row. Ties go to the smaller id. Other columns are not read and
may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql import Window as W

from .common import column, give_back, materialize, numbers_of, record_batch

#: Vectors that the tree's top is grown from, rows and anchors of a group, rows of a bucket.
SAMPLE, SHARD, QUERIES, BUCKET = 4096, 4096, 1024, 256
#: Sum of squares from which scores might not fit.
MOST_NORM = 1 << 60
ROWS = "leaf int, shard int, vec_id long, label long, vec array<long>"
ASKS = "leaf int, qid long, label long, vec array<long>, ask array<struct<low:long,high:long>>"
FOUND = "qid long, ask int, vec_id long, score long"


def prepare(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, vec being floor(scale * x)."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    norm = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))
    own = own.where(norm < float(MOST_NORM)).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("vec"))
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("first")).select("vec_id", "first.*")


def matrix(vectors: list[np.ndarray], width: int | None = None) -> np.ndarray:
    """Vectors as the rows of a matrix of integers, ends filled with zeros."""
    out = np.zeros((len(vectors), width or max(map(len, vectors), default=0)), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def vectors_of(array: pa.Array) -> list[np.ndarray]:
    """A column of lists without nulls, as arrays."""
    flat, at = array.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(array.value_lengths().to_numpy(zero_copy_only=False)))
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats while these hold all sums, else in integers."""
    reach = np.sqrt(norms(a).max(initial=0) * norms(b).max(initial=0))
    if reach < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def norms(a: np.ndarray) -> np.ndarray:
    return np.square(a.astype(np.float64)).sum(1)


class Space:
    """Distances between norm-augmented vectors, with slack for rounding."""

    def __init__(self, largest: float):
        self.largest = largest

    def augment(self, a: np.ndarray) -> np.ndarray:
        return np.column_stack([a.astype(np.float64), np.sqrt(np.maximum(0.0, self.largest - norms(a)))])

    def anchor(self, a: np.ndarray) -> np.ndarray:
        return np.column_stack([a.astype(np.float64), np.zeros(len(a))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norms(a)[:, None] + norms(b)[None, :] - 2 * (a @ b.T)))

    def of_score(self, norm: np.ndarray, score: np.ndarray, nearer: bool) -> np.ndarray:
        """The distance of a score, rounded down if ``nearer``, else up."""
        square = norm + self.largest - 2 * np.asarray(score, np.float64)
        slack = 1e-9 * (norm + self.largest + 1)
        return np.sqrt(np.maximum(0.0, square - slack if nearer else square + slack))


class Tree:
    """A vantage-point tree: each inner node has a vantage point and a distance, each leaf the distances that its rows have to the points above it."""

    def __init__(self, points: np.ndarray, space: Space, most: int, seed: int = 12):
        self.space, self.points, self.paths, self.members = space, [], [], []
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray, path: list[tuple[int, float, float]]):
            x = points[rows]
            if len(rows) > most:
                v = points[rows[rng.integers(len(rows))]]
                d = space.between(x, v[None])[:, 0]
                mu = float(np.median(d))
                inside = d <= mu
                if 0 < inside.sum() < len(rows):
                    k = len(self.points)
                    self.points.append(v)
                    return k, mu, grow(rows[inside], [*path, (k, 0.0, mu)]), grow(rows[~inside], [*path, (k, mu, np.inf)])
            self.paths.append(path)
            self.members.append(rows)
            return len(self.paths) - 1

        self.root = grow(np.arange(len(points)), [])

    def tighten(self, points: np.ndarray) -> None:
        """Narrow each leaf's distances to those of its members."""
        for leaf, rows in enumerate(self.members):
            for step, (k, _, _) in enumerate(self.paths[leaf]):
                d = self.space.between(points[rows], self.points[k][None])[:, 0]
                self.paths[leaf][step] = (k, float(d.min()), float(d.max()))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int32)

        def go(node, rows: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                k, mu, near, far = node
                inside = self.space.between(points[rows], self.points[k][None])[:, 0] <= mu
                go(near, rows[inside])
                go(far, rows[~inside])

        go(self.root, np.arange(len(points)))
        return out

    def reach(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds on the distances of each anchor to the rows of each leaf (anchors x leaves), by the triangle inequality."""
        low, high = np.zeros((len(anchors), len(self.paths))), np.full((len(anchors), len(self.paths)), np.inf)
        if self.points:
            d = self.space.between(anchors, np.stack(self.points))
            slack = 1e-6 * (1 + np.sqrt(self.space.largest))
            for leaf, path in enumerate(self.paths):
                for k, lo, hi in path:
                    low[:, leaf] = np.maximum(low[:, leaf], np.maximum(d[:, k] - hi, lo - d[:, k]) - slack)
                    high[:, leaf] = np.minimum(high[:, leaf], d[:, k] + hi + slack)
        return low, high


def first_rows(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, anchors: np.ndarray, own: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, largest: float, bucket: int = BUCKET):
    """(ask, id, score) of the first k rows for each ask: the highest scores from ``low`` to ``high``, of the anchor's own label if ``same``, else of others.

    ``of`` is the anchor of each ask, ``own`` each anchor's label. All asks go on in
    step: in step s each takes its s-th nearest bucket, if its bounds reach so far.
    """
    space, asks = Space(largest), len(of)
    points, near = space.augment(rows), space.anchor(anchors)
    tree = Tree(points, space, bucket)
    tree.tighten(points)
    least, most = tree.reach(near)
    order, norm = np.argsort(least, axis=1, kind="stable"), norms(anchors)[of]
    inner, outer = space.of_score(norm, high, nearer=True), space.of_score(norm, low, nearer=False)
    score, got = np.full((asks, k), np.iinfo(np.int64).min), np.full((asks, k), np.iinfo(np.int64).max)
    open_ = np.ones(asks, bool)
    for step in range(len(tree.paths)):
        leaf = order[of, step]
        open_ &= least[of, leaf] <= outer
        due = np.flatnonzero(open_ & (most[of, leaf] >= inner))
        for b in np.unique(leaf[due]):
            a, members = due[leaf[due] == b], tree.members[b]
            who, at = np.unique(of[a], return_inverse=True)
            s = products(anchors[who], rows[members])[at]
            fits = (s >= low[a, None]) & (s <= high[a, None]) & ((labels[members][None, :] == own[of[a], None]) == same)
            s = np.where(fits, s, np.iinfo(np.int64).min)
            both, names = np.concatenate([score[a], s], 1), np.concatenate([got[a], np.where(fits, ids[members][None, :], np.iinfo(np.int64).max)], 1)
            best = np.lexsort((names, ~both), axis=1)[:, :k]
            score[a], got[a] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        full = got[:, -1] < np.iinfo(np.int64).max  # nothing beyond the k-th row counts
        outer = np.where(full, np.minimum(outer, space.of_score(norm, score[:, -1], nearer=False)), outer)
        if not open_.any():
            break
    ask, place = np.nonzero(got < np.iinfo(np.int64).max)
    return ask, got[ask, place], score[ask, place]


def _deal(batches, top, parts: dict[int, int] | None):
    tree, width = top.value
    schema = pa.schema([("leaf", pa.int32()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.int64()))])
    for batch in batches:
        if batch.num_rows:
            leaf = tree.home(tree.space.augment(matrix(vectors_of(column(batch, "vec")), width)))
            ids = numbers_of(batch, "vec_id")
            spread = (ids.view(np.uint64) * np.uint64(0x9E3779B185EBCA87)) >> np.uint64(33)
            shard = spread % np.array([(parts or {}).get(int(x), 1) for x in leaf], np.uint64)
            yield record_batch(schema, [leaf, shard.astype(np.int32), ids, column(batch, "label"), column(batch, "vec")])
    give_back()


def _visits(batches, top, seed: bool):
    """Each anchor for each leaf that one of its asks reaches; with ``seed`` only the nearest leaf."""
    tree, width = top.value
    schema = pa.schema([("leaf", pa.int32()), ("qid", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        a = matrix(vectors_of(column(batch, "vec")), width)
        least, most = tree.reach(tree.space.anchor(a))
        if seed:
            hit = np.zeros(least.shape, bool)
            hit[np.arange(len(a)), least.argmin(1)] = True
        else:
            asks = column(batch, "ask")
            of = np.repeat(np.arange(len(a)), asks.value_lengths().to_numpy(zero_copy_only=False))
            flat = asks.flatten()
            low, high = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("low", "high"))
            norm, hit = norms(a)[of], np.zeros(least.shape, bool)
            np.logical_or.at(hit, of, (least[of] <= tree.space.of_score(norm, low, nearer=False)[:, None]) & (most[of] >= tree.space.of_score(norm, high, nearer=True)[:, None]))
        row, leaf = np.nonzero(hit)
        yield record_batch(schema, [leaf.astype(np.int32), numbers_of(batch, "qid")[row]])


def _search(k: int, same: bool, largest: float):
    schema = pa.schema([("qid", pa.int64()), ("ask", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        xs, qs = (vectors_of(t["vec"].combine_chunks()) for t in (rows, queries))
        width = max(max(map(len, xs)), max(map(len, qs)))
        asks = queries["ask"].combine_chunks()
        counts = asks.value_lengths().to_numpy(zero_copy_only=False)
        of, flat = np.repeat(np.arange(len(qs)), counts), asks.flatten()
        low, high = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("low", "high"))
        ask, ids, score = first_rows(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(xs, width), matrix(qs, width), queries["label"].to_numpy(), of, low, high, k, same, largest)
        number = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        return pa.table([queries["qid"].to_numpy()[of[ask]], number[ask], ids, score], schema=schema)

    return search


class Index:
    """Rows dealt to the shards of a tree, to be searched by many anchors."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, shard: int = SHARD):
        spark = rows.sparkSession
        n, top, width = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.max(F.size("vec"))).first()
        self.largest, self.width = float(top or 0.0), int(width or 0)
        bound = int((1 << 40) * min(1.0, sample / max(1, n)))
        some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < bound).select("vec").orderBy("vec").collect() if n > shard else []
        space = Space(self.largest)
        points = space.augment(matrix([np.array(r["vec"], np.int64) for r in some], self.width)) if some else np.zeros((0, self.width + 1))
        tree = Tree(points, space, max(16, -(-len(points) * shard // max(1, n))))
        tree.members = []
        self.top = spark.sparkContext.broadcast((tree, self.width))
        homes = rows.mapInArrow(partial(_deal, top=self.top, parts=None), ROWS).groupBy("leaf").count().collect()
        self.parts = {r["leaf"]: -(-r["count"] // shard) for r in homes}
        self.rows = materialize(rows.mapInArrow(partial(_deal, top=self.top, parts=self.parts), ROWS), "dealt")

    def first(self, anchors: DataFrame, k: int, same: bool, seed: bool = False, most: int = QUERIES) -> DataFrame:
        """(qid, ask, vec_id, score, rank): the first k rows for each ask of each anchor.

        ``anchors`` has qid, label, vec and ask, an array of score windows.
        """
        spark = anchors.sparkSession
        visits = materialize(anchors.select("qid", "vec", "ask").mapInArrow(partial(_visits, top=self.top, seed=seed), "leaf int, qid long"), "visits")
        blocks = {r["leaf"]: -(-r["count"] // most) for r in visits.groupBy("leaf").count().collect()}
        plan = F.broadcast(spark.createDataFrame([(leaf, blocks[leaf], parts) for leaf, parts in self.parts.items() if leaf in blocks], "leaf int, blocks int, shards int"))  # a row for each leaf
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block")
        asked = visits.join(plan, "leaf").select("leaf", each("shards").alias("shard"), block, "qid").join(anchors, "qid")
        rows = self.rows.join(plan, "leaf").withColumn("block", each("blocks")).drop("blocks", "shards")
        keys = ["leaf", "shard", "block"]
        found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(k, same, self.largest), FOUND)
        best = W.partitionBy("qid", "ask").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fewest_ids(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with the same vector and label the k smallest ids; each task already leaves out the rest of its own."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("vec", "label").orderBy("vec_id"))).where(F.col("rank") <= k).drop("rank")


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least_percent: int = 80, sample: int = SAMPLE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` as ``prepare`` gives them.

    ``is_anchor`` is a condition on them. A negative's score lies between
    ``least_percent`` of its positive's and all of it.
    """
    rows = materialize(rows, "vectors")
    index = Index(materialize(fewest_ids(rows, max(positives + 1, negatives)), "fewest"), sample, shard)
    anchors = rows.where(is_anchor)
    wide = (1 << 62) - 1
    asked = anchors.select("vec", "label").distinct().withColumn("qid", F.monotonically_increasing_id())
    asked = materialize(asked, "asked")
    everything = asked.withColumn("ask", F.array(F.struct(F.lit(-wide).alias("low"), F.lit(wide).alias("high"))))
    near = index.first(everything, positives + 1, True, seed=True, most=queries).where(F.col("rank") == positives + 1).select("qid", F.col("score").alias("at_least"))
    bounded = asked.join(near, "qid", "left").withColumn("ask", F.array(F.struct(F.coalesce("at_least", F.lit(-wide)).alias("low"), F.lit(wide).alias("high")))).drop("at_least")
    same = materialize(index.first(materialize(bounded, "bounded"), positives + 1, True, most=queries).select("qid", "vec_id", "score", "rank"), "positives")
    scores = same.groupBy("qid").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    # A long times a percentage, rounded up, in parts that can't overflow.
    low = f"(s div 100) * {least_percent} + cast(ceil((s % 100) * {least_percent} / 100) as bigint)"
    exact = F.expr(f"transform(scores, s -> named_struct('low', {low}, 'high', s))")
    windows = materialize(asked.join(scores, "qid").withColumn("ask", exact), "windows")
    hard = index.first(windows.select("qid", "label", "vec", "ask"), negatives, False, most=queries)
    named = windows.select("qid", F.posexplode("scores").alias("ask", "positive_score"))
    hard = hard.join(named, ["qid", "ask"]).select("qid", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    per_anchor = anchors.select(F.col("vec_id").alias("anchor_id"), "vec", "label").join(asked, ["vec", "label"]).select("anchor_id", "qid")
    nearest = same.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("nearest"))
    others = F.slice(F.filter("nearest", lambda x: x["positive_id"] != F.col("anchor_id")), 1, positives)
    chosen = per_anchor.join(nearest, "qid").select("anchor_id", "qid", F.explode(others).alias("p")).select("anchor_id", "qid", "p.positive_id", "p.positive_score")
    return chosen.join(hard, ["qid", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

