"""Learned pair scorers on Spark's own ML: decoder, benefit model, losses."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..sources.shared import written


def positive_weight(rows: DataFrame, cap: float = 10.0) -> float:
    """Negatives over positives, from 1 to ``cap``; 1 if either is missing."""
    r = rows.agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") != 1).cast("long")).alias("n")).first()
    return min(cap, max(1.0, r["n"] / r["p"])) if r["p"] and r["n"] else 1.0


def train_decoder(rows: DataFrame, features: list[str], rounds: int = 50, ridge: float = 0.01):
    """A logistic pair decoder over atoms; positives weigh more where they are rare."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    weight = positive_weight(rows)
    rows = rows.withColumn("__w", F.when(F.col("label") == 1, weight).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
    stages = [VectorAssembler(inputCols=features, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol="label", weightCol="__w", maxIter=rounds, regParam=ridge)]
    return Pipeline(stages=stages).fit(rows)


def score(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("__x", "__z", "rawPrediction", "probability", "prediction")


def losses(p: Column, y: Column, positive: float = 1.0, gamma: float = 2.0) -> dict[str, Column]:
    """Cross entropy and focal loss of probabilities, as Columns to be averaged."""
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    right = F.when(y == 1, p).otherwise(1 - p)
    weight = F.when(y == 1, positive).otherwise(1.0)
    return {"bce": -weight * F.log(right), "focal": -weight * F.pow(1 - right, F.lit(gamma)) * F.log(right)}


def contrastive_loss(rows: DataFrame, batch: str, vector: str = "embedding", label: str = "label", temperature: float = 0.1, most: int = 4096) -> DataFrame:
    """(batch, loss): for each positive, how little likelier other positives are than all of the batch; -1 labels don't count.

    Each positive meets the rows of its batch once and keeps three sums, so nothing grows
    with a row but these. A batch of more than ``most`` rows is an error, as every positive looks at all of them.
    """
    own = rows.where(F.col(label) != -1).select(batch, F.col(label).cast("int").alias("y"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    size = own.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"))
    if (largest := size.agg(F.max("rows")).first()[0] or 0) > most:
        raise ValueError(f"a batch has {largest} rows; deal it into batches of up to {most}")
    own = written(own.withColumn("k", F.monotonically_increasing_id()), "contrast")
    me, other = own.where("y = 1").select(batch, F.col("k").alias("me"), F.col("v").alias("mine")), own.select(batch, "k", "y", "v")
    dot = F.aggregate(F.zip_with("mine", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / temperature
    near = (F.col("y") == 1) & (F.col("k") != F.col("me"))
    sums = me.join(other, batch).withColumn("s", dot).groupBy(batch, "me").agg(F.log(F.sum(F.exp("s"))).alias("all"), F.sum(F.when(near, F.col("s"))).alias("near"), F.count(F.when(near, 1)).alias("others"))
    mean = F.coalesce(F.col("near") - F.col("others") * F.col("all"), F.lit(0.0)) / (F.col("others") + 1e-8)
    loss = sums.groupBy(batch).agg((-F.avg(mean)).alias("loss"), F.count(F.lit(1)).alias("n"))
    return size.select(batch).join(loss, batch, "left").select(batch, F.when(F.col("n") > 1, F.col("loss")).otherwise(0.0).alias("loss"))


def train_early(train: DataFrame, validate: DataFrame, features: list[str], epochs: int = 120, patience: int = 20, rate: float = 0.5) -> tuple[list[float], list[dict]]:
    """Weights (bias last) of a logistic scorer by steepest descent, and what each epoch gave.

    An epoch is one combining aggregate over all training rows; positives weigh more
    where they are rare. It ends after ``patience`` epochs without a better F1 at 0.5
    on the validation rows, and gives back the weights of the best one.
    """
    train, validate = (d.select(F.col("label").cast("int").alias("label"), *features).persist() for d in (train, validate))
    weights, best, history, waited = [0.0] * (len(features) + 1), None, [], 0
    probability = lambda w: 1 / (1 + F.exp(-(sum((F.col(f) * x for f, x in zip(features, w, strict=False)), F.lit(w[-1])))))
    positive = positive_weight(train)
    for epoch in range(1, epochs + 1):
        p = probability(weights)
        gap = F.when(F.col("label") == 1, positive * (p - 1)).otherwise(p)
        loss = losses(p, F.col("label"), positive)["bce"]
        got = train.agg(F.avg(loss).alias("loss"), F.avg(gap).alias("b"), *[F.avg(gap * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)]).first()
        if got["loss"] is None:
            break
        weights = [w - rate * got[g] for w, g in zip(weights, [*(f"g{i}" for i in range(len(features))), "b"], strict=True)]
        on, y = probability(weights) >= 0.5, F.col("label") == 1
        n = validate.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in (("tp", on & y), ("fp", on & ~y), ("fn", ~on & y))]).first()
        f1 = 2 * n["tp"] / d if (d := 2 * n["tp"] + n["fp"] + n["fn"]) else 0.0
        history.append({"epoch": epoch, "loss": got["loss"], "f1": f1})
        waited = 0 if best is None or f1 > best[0] else waited + 1
        best = (f1, weights) if not waited else best
        if waited >= patience:
            break
    train.unpersist(), validate.unpersist()
    return (best[1] if best else weights), history


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A linear layer with given weights over an array column."""
    row = lambda w, b: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, c: a * c), F.lit(float(b)), lambda s, v: s + v)
    return F.array(*[row(w, b) for w, b in zip(weights, bias, strict=True)])


def layer_norm(x: Column, eps: float = 1e-5, weight: list[float] | None = None, bias: list[float] | None = None) -> Column:
    """A vector less its mean, over its deviation; then times ``weight`` and plus ``bias``, number by number."""
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    var = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(x)
    out = F.transform(x, lambda v: (v - mean) / F.sqrt(var + eps))
    out = out if weight is None else F.zip_with(out, F.array(*map(F.lit, weight)), lambda v, w: v * w)
    return out if bias is None else F.zip_with(out, F.array(*map(F.lit, bias)), lambda v, b: v + b)


def interactions(u: Column, v: Column) -> Column:
    """What a pair decoder reads of two vectors: both, their distance and their product, element by element."""
    return F.concat(u, v, F.zip_with(u, v, lambda a, b: F.abs(a - b)), F.zip_with(u, v, lambda a, b: a * b))


def unit(x: Column) -> Column:
    """A vector over its length."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm)).otherwise(x)


def train_benefit(rows: DataFrame, threshold: float, atoms: tuple[str, ...] = (), rounds: int = 50, ridge: float = 0.01):
    """A weighted logistic model of where a delta helps; None unless there are rows of both kinds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from .rerank import benefit_features, benefit_targets

    target, weight = benefit_targets(threshold)
    features = benefit_features(threshold)
    rows = rows.withColumns(features | {"label": target.cast("double"), "__w": weight})
    if rows.select("label").distinct().count() < 2:
        return None
    stages = [VectorAssembler(inputCols=[*features, *atoms], outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True), LogisticRegression(featuresCol="__z", labelCol="label", weightCol="__w", maxIter=rounds, regParam=ridge)]
    return Pipeline(stages=stages).fit(rows)
