"""A pair decoder with hidden layers, trained in mini-batches on Spark.

A pair's input is turned by two linear maps with a bend between them into a hidden
vector, from which one map reads the link's logit and two more a projection of length
one. Gradients are sums over rows: each task adds up those of its rows block by block
(``BLOCK`` rows as a matrix), its sums go out in pieces of ``PIECE`` numbers, and every
piece is added up by itself. Only the model, its moments and one gradient are on the driver.

Batches are a hash of the row's id, cut into slices by another, each a file whose rows
are in order. Blocks begin with a slice and sums are added up in the order of slices, so
a batch gives the same gradient to the last bit however its files are dealt to tasks, and
again after a lost executor. After every epoch the whole state goes to a checkpoint, from which training goes on
exactly where it was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.shared import folder
from .evaluate import best_grid_threshold
from .learn import interactions, positive_weight

#: Numbers of a gradient that are added up together.
PIECE = 4096
#: Rows of a block, and of a slice of a batch.
BLOCK, SLICE = 1024, 1 << 16
OUTPUT = StructType([StructField("logit", DoubleType()), StructField("hidden", ArrayType(DoubleType())), StructField("projection", ArrayType(DoubleType()))])


@dataclass(frozen=True)
class Loss:
    """Cross entropy with a weight for positives, or the focal loss."""

    kind: str = "bce"
    positive: float = 1.0
    alpha: float = 0.25
    gamma: float = 2.0

    def __call__(self, logit: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's loss and its slope by the logit."""
        p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        right = np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1.0)
        sign = np.where(y == 1, 1.0, -1.0)
        if self.kind == "bce":
            weight = np.where(y == 1, self.positive, 1.0)
            return -weight * np.log(right), weight * sign * (right - 1)
        if self.kind != "focal":
            raise ValueError(f"unknown loss: {self.kind}")
        weight, off = np.where(y == 1, self.alpha, 1 - self.alpha), (1 - right) ** self.gamma
        return -weight * off * np.log(right), weight * sign * off * (self.gamma * right * np.log(right) + right - 1)


class Model:
    """Weights of a decoder, all in one vector."""

    def __init__(self, inputs: int, hidden: int, vector: np.ndarray | None = None, seed: int = 0):
        self.inputs, self.hidden = inputs, hidden
        wide, narrow = max(2, hidden // 2), max(2, hidden // 4)
        self.shapes = {"w1": (hidden, inputs), "b1": (hidden,), "w2": (hidden, hidden), "b2": (hidden,), "out": (hidden,), "bias": (1,), "p1": (wide, hidden), "c1": (wide,), "p2": (narrow, wide), "c2": (narrow,)}
        if vector is None:
            rng = np.random.default_rng(seed)
            parts = [rng.uniform(-1, 1, shape) / np.sqrt(shape[-1]) if len(shape) == 2 or name == "out" else np.zeros(shape) for name, shape in self.shapes.items()]
            vector = np.concatenate([p.ravel() for p in parts])
        self.vector = np.asarray(vector, np.float64)
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes.values()])
        self.parts = {n: v.reshape(s) for (n, s), v in zip(self.shapes.items(), np.split(self.vector, ends[:-1]), strict=True)}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bent inputs, hidden vectors and logits."""
        p = self.parts
        bent = np.maximum(0.0, x @ p["w1"].T + p["b1"])
        hidden = bent @ p["w2"].T + p["b2"]
        return bent, hidden, hidden @ p["out"] + p["bias"][0]

    def project(self, hidden: np.ndarray) -> np.ndarray:
        p = self.parts
        q = np.maximum(0.0, hidden @ p["p1"].T + p["c1"]) @ p["p2"].T + p["c2"]
        return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def slopes(self, x: np.ndarray, y: np.ndarray, loss: Loss) -> tuple[np.ndarray, float]:
        """The sums over rows of the loss's gradient, in the order of ``vector``, and of the loss."""
        bent, hidden, logit = self.forward(x)
        value, d = loss(logit, y)
        p, at = self.parts, {n: np.zeros(s) for n, s in self.shapes.items()}
        at["out"], at["bias"] = d @ hidden, np.array([d.sum()])
        dh = d[:, None] * p["out"]
        at["w2"], at["b2"] = dh.T @ bent, dh.sum(0)
        dz = (dh @ p["w2"]) * (bent > 0)
        at["w1"], at["b1"] = dz.T @ x, dz.sum(0)
        return np.concatenate([at[n].ravel() for n in self.shapes]), float(value.sum())


def pair_input(u: Column, v: Column, features: Column | None = None, with_interactions: bool = False) -> Column:
    """What the decoder reads of a pair: both vectors (or these with their distance and product), then its features; missing ones are 0."""
    both = interactions(u, v) if with_interactions else F.concat(u, v)
    return both if features is None else F.concat(both, F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _task_slopes(batches, model, loss: Loss):
    """Sums for each run of a slice's rows, in blocks that begin with the run; ``first`` orders runs of one slice."""
    known, at, first, held, total = model.value, None, 0, [], None

    def add() -> None:
        nonlocal total, held
        x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        slope, value = known.slopes(x, y, loss)
        got = np.append(slope, [value, len(y)])
        total, held = got if total is None else total + got, []

    def done() -> pa.RecordBatch:
        nonlocal total
        if held:
            add()
        pieces = [total[k : k + PIECE] for k in range(0, len(total), PIECE)]
        total = None
        n = len(pieces)
        return pa.RecordBatch.from_pydict({"slice": pa.array([at] * n, pa.int32()), "first": pa.array([first] * n, pa.int64()), "piece": pa.array(range(n), pa.int32()), "x": pa.array(pieces, pa.list_(pa.float64()))})

    for batch in batches:
        if not batch.num_rows:
            continue
        slices, order = (batch[c].to_numpy(zero_copy_only=False) for c in ("slice", "order"))
        x, y = _matrix(batch["x"], known.inputs), batch["label"].to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
        for a, b in zip(edges, edges[1:], strict=False):
            if at != slices[a]:
                if at is not None:
                    yield done()
                at, first = int(slices[a]), int(order[a])
            while a < b:
                room = BLOCK - sum(len(h[1]) for h in held)
                held.append((x[a : min(b, a + room)], y[a : min(b, a + room)]))
                a = min(b, a + room)
                if sum(len(h[1]) for h in held) == BLOCK:
                    add()
    if at is not None:
        yield done()


def _add(group: pa.Table) -> pa.Table:
    ordered = group.sort_by([("slice", "ascending"), ("first", "ascending")])
    total = ordered["x"].combine_chunks().flatten().to_numpy().reshape(ordered.num_rows, -1)
    return pa.table({"piece": ordered["piece"][:1], "x": pa.array([np.add.reduce(total, axis=0)], pa.list_(pa.float64()))})


def gradient(rows: DataFrame, model: Model, loss: Loss = Loss()) -> tuple[np.ndarray, float, int]:
    """The mean gradient and loss over ``rows`` (x, label), and their number; with slice and order, as ``batches_of`` gives them, the same to the last bit each time."""
    known = rows.sparkSession.sparkContext.broadcast(model)
    if "slice" not in rows.columns:
        rows = rows.withColumns({"slice": F.spark_partition_id(), "order": F.monotonically_increasing_id()})
    own = rows.select("x", F.col("label").cast("int").alias("label"), "slice", "order")
    parts = own.mapInArrow(partial(_task_slopes, model=known, loss=loss), "slice int, first long, piece int, x array<double>")
    found = sorted(parts.groupBy("piece").applyInArrow(_add, "piece int, x array<double>").collect(), key=lambda r: r["piece"])
    known.unpersist()
    if not found:
        return np.zeros_like(model.vector), 0.0, 0
    flat = np.concatenate([r["x"] for r in found])
    n = int(flat[-1])
    return flat[:-2] / n, flat[-2] / n, n


def decode(x: Column, model: Model) -> Column:
    """A struct of logit, hidden vector and projection for each input, in Arrow batches."""

    @F.pandas_udf(OUTPUT)
    def run(inputs: pd.Series) -> pd.DataFrame:
        if not len(inputs):
            return pd.DataFrame({"logit": [], "hidden": [], "projection": []})
        _, hidden, logit = model.forward(np.stack(inputs.to_list()).astype(np.float64))
        return pd.DataFrame({"logit": logit, "hidden": list(hidden), "projection": list(model.project(hidden))})

    return run(x)


def score(rows: DataFrame, model: Model, replay: bool = False) -> DataFrame:
    """Adds ``score``; with ``replay`` also the decoder's input, hidden vector and projection, to be looked at later."""
    out = rows.withColumn("__d", decode(F.col("x"), model)).withColumn("score", 1 / (1 + F.exp(-F.col("__d.logit"))))
    if replay:
        out = out.withColumns({"decoder_input": F.col("x"), "edge_hidden": F.col("__d.hidden"), "projection": F.col("__d.projection")})
    return out.drop("__d")


@dataclass(frozen=True)
class State:
    """All that training goes on from."""

    vector: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    epoch: int = 0
    best: np.ndarray | None = None
    best_f1: float = -1.0
    best_threshold: float = 0.5
    waited: int = 0

    def save(self, spark: SparkSession, path: str) -> None:
        numbers = {k: getattr(self, k) for k in ("step", "epoch", "best_f1", "best_threshold", "waited")}
        arrays = {k: [float(x) for x in (getattr(self, k) if getattr(self, k) is not None else [])] for k in ("vector", "first", "second", "best")}
        row = [(json.dumps(numbers), *arrays.values())]
        spark.createDataFrame(row, "numbers string, " + ", ".join(f"{k} array<double>" for k in arrays)).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={self.epoch}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> State | None:
        """The last state that was written whole."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        names = [s.getPath().toString() for s in fs.listStatus(p)]
        done = [n for n in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{n}/_SUCCESS"))]
        if not done:
            return None
        row = spark.read.parquet(max(done, key=lambda n: int(n.rsplit("=", 1)[1]))).first()
        arrays = {k: np.array(row[k]) for k in ("vector", "first", "second", "best")}
        return State(**json.loads(row["numbers"]), **(arrays | {"best": arrays["best"] if len(arrays["best"]) else None}))


def adam(state: State, slope: np.ndarray, rate: float, decay: float = 0.0, beta1: float = 0.9, beta2: float = 0.999) -> State:
    """A step with running means of the gradient and of its square."""
    g = slope + decay * state.vector
    first, second, t = beta1 * state.first + (1 - beta1) * g, beta2 * state.second + (1 - beta2) * g * g, state.step + 1
    move = (first / (1 - beta1**t)) / (np.sqrt(second / (1 - beta2**t)) + 1e-8)
    return replace(state, vector=state.vector - rate * move, first=first, second=second, step=t)


def batches_of(rows: DataFrame, count: int, seed: int, id_col: str = "id", rows_of_slice: int = SLICE) -> list[DataFrame]:
    """Rows (x, label, slice, order) in ``count`` batches by a hash of their ids, each slice a file written by one task, in order."""
    path = folder(rows.sparkSession, "batches")
    slices = max(1, -(-rows.count() // (count * rows_of_slice)))
    part = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), id_col), F.lit(n)).cast("int")
    dealt = rows.select("x", F.col("label").cast("int").alias("label"), part(1, slices).alias("slice"), F.xxhash64(F.lit(seed), id_col).alias("order"), part(0, count).alias("batch"))
    dealt.repartition("batch", "slice").sortWithinPartitions("batch", "slice", "order", "x", "label").write.partitionBy("batch").parquet(path)
    return [dealt.sparkSession.read.schema(dealt.schema).parquet(path).where(F.col("batch") == k).select("x", "label", "slice", "order") for k in range(count)]


def train(rows: DataFrame, validate: DataFrame, hidden: int = 32, epochs: int = 120, patience: int = 20, batches: int = 8, rate: float = 0.001, loss: Loss | None = None, seed: int = 0, checkpoints: str | None = None, id_col: str = "id") -> tuple[Model, float, list[dict]]:
    """The model that did best on ``validate``, its threshold, and what each epoch gave.

    Rows have an id, x and label. An epoch takes every batch once, in an order drawn from
    the seed and its number. Best is the highest F1 over thresholds on the validation
    rows; training ends after ``patience`` epochs without a better one. With a
    ``checkpoints`` folder it goes on from the last epoch written there.
    """
    spark = rows.sparkSession
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no rows to train on")
    inputs = len(first["x"])
    loss = loss or Loss(positive=positive_weight(rows))
    dealt, history = batches_of(rows, batches, seed, id_col), []
    fresh = Model(inputs, hidden, seed=seed).vector
    state = (checkpoints and State.load(spark, checkpoints)) or State(fresh, np.zeros_like(fresh), np.zeros_like(fresh))
    while state.epoch < epochs and state.waited < patience:
        epoch, lost, seen = state.epoch + 1, 0.0, 0
        for k in np.random.default_rng([seed, epoch]).permutation(batches):
            slope, value, n = gradient(dealt[k], Model(inputs, hidden, state.vector), loss)
            if n:
                state, lost, seen = adam(state, slope, rate), lost + value * n, seen + n
        found = best_grid_threshold(score(validate, Model(inputs, hidden, state.vector))).first()
        threshold, f1 = (found["threshold"], found["best_f1"]) if found else (0.5, 0.0)
        better = f1 > state.best_f1
        state = replace(state, epoch=epoch, waited=0 if better else state.waited + 1)
        state = replace(state, best=state.vector, best_f1=f1, best_threshold=threshold) if better else state
        history.append({"epoch": epoch, "loss": lost / max(1, seen), "f1": f1, "threshold": threshold})
        if checkpoints:
            state.save(spark, checkpoints)
    return Model(inputs, hidden, state.best if state.best is not None else state.vector), state.best_threshold, history
