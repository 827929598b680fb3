"""What is done to scores once a delta is known: gates, application, search of settings, benefit."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .evaluate import _over


@dataclass(frozen=True)
class Setting:
    cap: float = 1.0
    alpha: float = 1.0
    margin: float = 1.0
    delta_min: float = 0.0
    min_benefit: float = 0.0


def gate(s: Column, delta: Column, threshold: float, c: Setting) -> Column:
    """Near the threshold, where a margin under 1 is set, and of some size, where one is."""
    out = F.lit(True)
    if c.margin < 1:
        out = out & (F.abs(s - threshold) <= c.margin)
    return out & (F.abs(delta) >= c.delta_min) if c.delta_min > 0 else out


def benefit(c: Setting, probability: Column | None) -> Column:
    if c.min_benefit <= 0:
        return F.lit(True)
    if probability is None:
        raise ValueError("a least benefit needs probabilities")
    return probability >= c.min_benefit


def reranked(s: Column, delta: Column, threshold: float, c: Setting, probability: Column | None = None) -> Column:
    move = F.least(F.greatest(delta, F.lit(-c.cap)), F.lit(c.cap)) * (gate(s, delta, threshold, c) & benefit(c, probability)).cast("double")
    return F.least(F.greatest(s + c.alpha * move, F.lit(0.0)), F.lit(1.0))


def settings(caps, alphas, margins, delta_mins=(0.0,), benefits=(0.0,)) -> list[Setting]:
    return [Setting(*x) for x in product(caps, alphas, margins, delta_mins, benefits)]


def search(rows: DataFrame, grid: list[Setting], threshold: float, most_active: float = 1.0, probability: str | None = None) -> DataFrame:
    """Every setting with its F1, gap of fixes over breaks and share of active rows, best first.

    ``rows``: (s, delta, label). One pass: each setting is a few sums of the same
    aggregate. Settings that act on too many rows come after all others.
    """
    s, d, p = F.col("s"), F.col("delta"), F.col(probability) if probability else None
    y, was = F.col("label") == 1, F.col("s") >= threshold
    aggs = []
    for i, c in enumerate(grid):
        now, active = reranked(s, d, threshold, c, p) >= threshold, gate(s, d, threshold, c) & benefit(c, p) & (d != 0)
        count = {"tp": now & y, "fp": now & ~y, "fn": ~now & y, "fixes": (was != y) & (now == y), "breaks": (was == y) & (now != y), "active": active}
        aggs.append(F.struct(F.lit(i).alias("ordinal"), *[F.lit(getattr(c, f)).alias(f) for f in Setting.__dataclass_fields__], *[F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(n) for n, x in count.items()], F.count(F.lit(1)).alias("n")))
    out = rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    out = out.withColumns({"f1": _over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "fix_gap": F.col("fixes") - F.col("breaks"), "active_ratio": _over(F.col("active"), F.col("n"))})
    over = (F.col("active_ratio") > most_active).cast("int")
    return out.orderBy(over, F.desc("f1"), F.desc("fix_gap"), "breaks", "active_ratio", "cap", "alpha", "margin", "ordinal")


def benefit_features(threshold: float) -> dict[str, Column]:
    s, d = F.col("s"), F.col("delta")
    return {"base": s, "distance": s - threshold, "abs_distance": F.abs(s - threshold), "delta": d, "abs_delta": F.abs(d), "projected": s + d, "projected_distance": s + d - threshold, "abs_projected_distance": F.abs(s + d - threshold), "log_src_degree": F.log1p(F.col("src_degree").cast("double")), "log_dst_degree": F.log1p(F.col("dst_degree").cast("double"))}


def benefit_targets(threshold: float, margin: float = 0.15) -> tuple[Column, Column]:
    """Whether a delta would help, and the row's weight.

    It helps where the score is wrong and the delta moves it towards the label.
    Wrong rows weigh most; any weighs up to twice as much near the threshold.
    """
    s, d, y = F.col("s"), F.col("delta"), F.col("label") == 1
    wrong = (s >= threshold) != y
    towards, moves = F.when(y, d > 1e-9).otherwise(d < -1e-9), F.abs(d) > 1e-9
    base = F.when(~moves, 0.10).when(wrong & towards, 1.50).when(wrong, 1.25).when(~towards, 0.75).otherwise(0.25)
    near = 1 + F.greatest(F.lit(0.0), 1 - F.abs(s - threshold) / margin)
    return (wrong & towards).cast("int"), base * near


def residual_feature(x: Column, threshold: float, boundary: bool, width: float = 0.15) -> Column:
    """Evidence, faded out with distance from the threshold where asked."""
    return x * F.least(F.greatest(1 - F.abs(F.col("s") - threshold) / width, F.lit(0.0)), F.lit(1.0)) if boundary else x


def normal_equations(rows: DataFrame, features: list[str], target: str, weight: str, ridge: float = 1.0) -> list[float]:
    """Ridge coefficients, the intercept first and not penalised: sums on the executors, a small system on the driver."""
    import numpy as np

    x, w = [F.lit(1.0), *map(F.col, features)], F.col(weight)
    k = len(x)
    pick = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.sum(w * x[i] * x[j]) for i, j in pick], *[F.sum(w * x[i] * F.col(target)) for i in range(k)]).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pick, got, strict=False):
        a[i, j] = a[j, i] = v or 0.0
    b = np.array([v or 0.0 for v in got[len(pick) :]])
    return np.linalg.solve(a + ridge * np.diag([0.0] + [1.0] * (k - 1)) + 1e-12 * np.eye(k), b).tolist()


def with_residual(s: Column, residual: Column, active: Column, threshold: float, margin: float) -> Column:
    """Adds a residual near the threshold to scores that no rule has moved."""
    open_ = ~active & (F.abs(s - threshold) <= margin)
    return F.when(open_, F.least(F.greatest(s + residual, F.lit(0.0)), F.lit(1.0))).otherwise(s)


def search_residual(rows: DataFrame, threshold: float, margins: list[float], caps: list[float]) -> DataFrame:
    """Margins and caps of a residual by F1, gap of fixes over breaks, fewest breaks and rows touched. ``rows``: (s, residual, active, label)."""
    s, y = F.col("s"), F.col("label") == 1
    aggs = []
    for i, (m, c) in enumerate(product(margins, caps)):
        residual = F.least(F.greatest(F.col("residual"), F.lit(-c)), F.lit(c))
        now, was = with_residual(s, residual, F.col("active"), threshold, m) >= threshold, s >= threshold
        count = {"tp": now & y, "fp": now & ~y, "fn": ~now & y, "fixes": (was != y) & (now == y), "breaks": (was == y) & (now != y), "touched": ~F.col("active") & (F.abs(s - threshold) <= m)}
        aggs.append(F.struct(F.lit(i).alias("ordinal"), F.lit(m).alias("margin"), F.lit(c).alias("cap"), *[F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(n) for n, x in count.items()]))
    out = rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    out = out.withColumns({"f1": _over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "fix_gap": F.col("fixes") - F.col("breaks")})
    return out.orderBy(F.desc("f1"), F.desc("fix_gap"), "breaks", "touched", "ordinal")
