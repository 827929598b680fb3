"""Graph encoder layers with given weights, as joins and combining aggregates.

Edges are (src, dst, edge), vectors (node, embedding), both arrays of doubles. What
meets along an edge is one row per edge; sums over a node's edges are made element
by element, with partial sums before the shuffle, so a node may have any number of
edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..sources.shared import written
from .graph import pool, softmax
from .learn import dense, layer_norm

Weights = tuple[list[list[float]], list[float]]
#: Fixed value: slope of negative inputs before attention scores are taken.
SLOPE = 0.2


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _product(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def _heads(scores: Column, values: Column, heads: int, size: int) -> Column:
    """A row for each head: its score and its part of the values."""
    return F.explode(F.array(*[F.struct(F.lit(h).alias("head"), scores[h].alias("score"), F.slice(values, h * size + 1, size).alias("value")) for h in range(heads)]))


def _gather(scored: DataFrame, vectors: DataFrame, size: int, width: int) -> DataFrame:
    """(node, embedding): values of incoming edges weighted by the softmax of scores, head after head; zeros without edges."""
    weighed = softmax(scored.withColumn("group", F.struct("dst", "head")), "group")
    parts = weighed.select("dst", "head", "weight", F.posexplode("value").alias("k", "x"))
    sums = parts.groupBy(F.col("dst").alias("node"), (F.col("head") * size + F.col("k")).alias("pos")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    rows = sums.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("sums"))  # ``width`` numbers a node
    return vectors.select("node").join(rows, "node", "left").select("node", F.coalesce("sums", F.array(*[F.lit(0.0)] * width)).alias("embedding"))


def _along(edges: DataFrame, vectors: DataFrame, source: dict[str, Weights], target: dict[str, Weights]) -> DataFrame:
    """Edges with linear maps of both ends' vectors."""
    one = vectors.select(F.col("node").alias("src"), *[dense(F.col("embedding"), *w).alias(n) for n, w in source.items()])
    two = vectors.select(F.col("node").alias("dst"), *[dense(F.col("embedding"), *w).alias(n) for n, w in target.items()])
    return edges.join(one, "src").join(two, "dst")


def attend(edges: DataFrame, vectors: DataFrame, weights: dict[str, Weights], heads: int) -> DataFrame:
    """Attention of each node over its incoming edges, whose vectors are added to the keys. ``weights``: q, k, v, edge, out."""
    width = len(weights["q"][1])
    size = width // heads
    rows = _along(edges, vectors, {"k": weights["k"], "v": weights["v"]}, {"q": weights["q"]})
    rows = rows.withColumn("k", F.zip_with("k", dense(F.col("edge"), *weights["edge"]), lambda a, b: a + b))
    part = lambda c, h: F.slice(c, h * size + 1, size)
    scores = F.array(*[_product(part("q", h), part("k", h)) / math.sqrt(size) for h in range(heads)])
    scored = rows.select("dst", _heads(scores, F.col("v"), heads, size).alias("x")).select("dst", "x.*")
    return _gather(scored, vectors, size, width).select("node", dense(F.col("embedding"), *weights["out"]).alias("embedding"))


def with_loops(edges: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Edges with one loop at each node in place of any it has; a loop's vector is the mean of those that come in."""
    own = edges.where("src <> dst")
    means = own.select(F.col("dst").alias("node"), F.posexplode("edge").alias("pos", "x")).groupBy("node", "pos").agg(F.avg("x").alias("x"))
    means = means.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("edge"))
    loops = vectors.select("node").join(means, "node", "left")
    return own.select("src", "dst", "edge").unionByName(loops.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.coalesce("edge", F.array(*[F.lit(0.0)] * width)).alias("edge")))


def graph_attention(edges: DataFrame, vectors: DataFrame, weights: dict[str, Weights], score: list[list[float]], bias: list[float], heads: int) -> DataFrame:
    """Attention whose scores come from both ends and the edge after a leaky bend. ``weights``: left (sources), right (targets), edge; ``score`` has a row a head."""
    width = len(weights["left"][1])
    size = width // heads
    rows = _along(with_loops(edges, vectors, len(weights["edge"][0][0])), vectors, {"l": weights["left"]}, {"r": weights["right"]})
    mixed = F.zip_with(F.zip_with("l", "r", lambda a, b: a + b), dense(F.col("edge"), *weights["edge"]), lambda a, b: a + b)
    rows = rows.withColumn("m", F.transform(mixed, lambda x: F.when(x > 0, x).otherwise(SLOPE * x)))
    scores = F.array(*[_product(F.slice("m", h * size + 1, size), F.array(*map(F.lit, score[h]))) for h in range(heads)])
    scored = rows.select("dst", _heads(scores, F.col("l"), heads, size).alias("x")).select("dst", "x.*")
    plus = F.array(*map(F.lit, bias))
    return _gather(scored, vectors, size, width).select("node", F.zip_with("embedding", plus, lambda a, b: a + b).alias("embedding"))


def neighbour_mean(edges: DataFrame, vectors: DataFrame, own: Weights, others: Weights) -> DataFrame:
    """A linear map of each vector, plus one of the mean of incoming neighbours' (zeros without any)."""
    width = len(others[0][0])
    reached = edges.select(F.col("dst").alias("node")).distinct().withColumn("reached", F.lit(True))
    means = pool(edges, vectors).select("node", F.col("embedding").alias("mean")).join(reached, "node", "left")
    mean = F.when(F.col("reached"), F.col("mean")).otherwise(F.array(*[F.lit(0.0)] * width))
    return vectors.join(means, "node").select("node", F.zip_with(dense(F.col("embedding"), *own), dense(mean, *others), lambda a, b: a + b).alias("embedding"))


def gated(before: DataFrame, out: DataFrame, gate: list[float], bias: float, norm: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """A layer's output, normalised (with ``norm``'s weights) and cut at 0, mixed with its input by a gate that reads both."""
    scaled = layer_norm(F.col("embedding")) if norm is None else layer_norm(F.col("embedding"), weight=norm[0], bias=norm[1])
    rows = before.select("node", F.col("embedding").alias("x")).join(out.select("node", F.transform(scaled, lambda v: F.greatest(v, F.lit(0.0))).alias("y")), "node")
    g = 1 / (1 + F.exp(-(_product(F.concat("x", "y"), F.array(*map(F.lit, gate))) + bias)))
    return rows.withColumn("g", g).select("node", F.zip_with(F.transform("x", lambda v: v * (1 - F.col("g"))), F.transform("y", lambda v: v * F.col("g")), lambda a, b: a + b).alias("embedding"))


@dataclass(frozen=True)
class Layer:
    """How a layer gathers from neighbours (edges and vectors to vectors), and the weights of its norm."""

    gather: Callable[[DataFrame, DataFrame], DataFrame]
    norm: tuple[list[float], list[float]]


@dataclass(frozen=True)
class Encoder:
    """A projection of the input, layers, and the gate that all of them share."""

    projection: Weights
    layers: tuple[Layer, ...]
    gate: list[float]
    bias: float

    def _start(self, vectors: DataFrame) -> DataFrame:
        return vectors.select("node", dense(F.transform("embedding", lambda x: x.cast("double")), *self.projection).alias("embedding"))

    def whole(self, edges: DataFrame, vectors: DataFrame) -> DataFrame:
        """(node, embedding) of all nodes: every layer over all edges (src, dst, edge)."""
        x = self._start(vectors)
        for layer in self.layers:
            x = written(gated(x, layer.gather(edges, x), self.gate, self.bias, layer.norm), "layer")
        return x

    def sampled(self, edges: DataFrame, vectors: DataFrame, seeds: DataFrame, fanouts: tuple[int, ...], seed: int = 0) -> DataFrame:
        """(node, embedding) of the seeds, from as many hops as there are layers.

        Hop k has up to ``fanouts[k]`` edges into each node that hop k - 1 needs. The first
        layer works on the outermost hop and gives what the next one reads; so each layer
        sees only nodes that the seeds depend on. With fan-outs beyond all degrees this is
        what ``whole`` gives for the seeds.
        """
        if len(fanouts) != len(self.layers):
            raise ValueError("a fan-out for each layer")
        needed, hops = [written(seeds.select("node").distinct(), "needed")], []
        for k, fanout in enumerate(fanouts):
            hop = written(sample_edges(edges, needed[-1], fanout, seed + k), "hop")
            hops.append(hop)
            needed.append(written(needed[-1].union(hop.select("src")).distinct(), "needed"))
        x = self._start(vectors.join(needed[-1], "node", "left_semi"))
        for layer, hop, nodes in zip(self.layers, reversed(hops), reversed(needed[:-1]), strict=True):
            inner = x.join(nodes, "node", "left_semi")
            x = written(gated(inner, layer.gather(hop, x), self.gate, self.bias, layer.norm), "layer")
        return x


def sample_edges(edges: DataFrame, nodes: DataFrame, fanout: int, seed: int = 0, parts: int = 64) -> DataFrame:
    """Up to ``fanout`` edges (src, dst, edge) into each of ``nodes``, by hash order; first within parts of a node's edges, so none is sorted whole."""
    into = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), "src", "dst", "edge"))
    cut = lambda df, by: df.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("h", "src"))).where(F.col("r") <= fanout)
    return cut(cut(into.withColumn("part", F.pmod("h", F.lit(parts))), ("dst", "part")), ("dst",)).select("src", "dst", "edge")
