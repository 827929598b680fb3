"""Evaluation of scored, labelled rows: counts, AUC, thresholds, elbow, mining.

Scores are brought to their distinct values by a combining aggregate, and running
totals over these are split into ranges, so no window sees all of them.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..sources.shared import written

OPS = {">=": lambda s, t: s >= t, ">": lambda s, t: s > t, "<=": lambda s, t: s <= t, "<": lambda s, t: s < t}


def decide(score: Column, threshold: float, op: str = ">=") -> Column:
    if op not in OPS:
        raise ValueError(f"unknown operator: {op}")
    return OPS[op](score, F.lit(threshold)).cast("int")


def _over(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / F.when(d > 0, d)).otherwise(0.0)


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {"accuracy": _over(tp + tn, tp + fp + fn + tn), "precision": _over(tp, tp + fp), "recall": _over(tp, tp + fn), "f1": _over(2 * tp, 2 * tp + fp + fn)}


def confusion(rows: DataFrame, threshold: float, op: str = ">=", by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn and the rates from (score, label) at one threshold."""
    p, y = decide(F.col("score"), threshold, op) == 1, F.col("label") == 1
    cells = {"tp": p & y, "fp": p & ~y, "fn": ~p & y, "tn": ~p & ~y}
    out = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in cells.items()])
    return out.select(*by, *cells, *[c.alias(n) for n, c in rates(*[F.col(n) for n in cells]).items()])


def _steps(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by, "score").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg"))


#: Rows that are added up in one range.
RANGE_ROWS = 1 << 16


def running(rows: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), range_rows: int | None = None) -> DataFrame:
    """Adds running totals up to and with each row, by rising ``order``: ``sums`` maps a new name to the column that it adds up.

    Rows are written once. More than ``range_rows`` are dealt into ranges of ``order``, of
    whatever kind it is; each has its totals within, and starts where those before it
    end, so no task sees all rows.
    """
    most = range_rows or RANGE_ROWS
    rows = written(rows, "running")
    n = rows.count()
    ranged = written(rows.repartitionByRange(-(-n // most), order).withColumn("range_no", F.spark_partition_id()), "ranges") if n > most else rows.withColumn("range_no", F.lit(0))
    keys = [*by, "range_no"]
    out = ranged.withColumns({name: F.sum(c).over(W.partitionBy(*keys).orderBy(order)) for name, c in sums.items()})
    if n <= most:
        return out.drop("range_no")
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"{name}_all") for name, c in sums.items()])
    before = W.partitionBy(*by).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"{name}_all").over(before), F.lit(0)).alias(f"{name}_start") for name in sums])
    same = reduce(lambda x, y: x & y, [out[k].eqNullSafe(starts[k]) for k in keys])
    return out.join(starts, same).select(*[out[c] for c in rows.columns], *[(out[name] + starts[f"{name}_start"]).alias(name) for name in sums])


def quantiles(rows: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(…, share, quantile): exact interpolated quantiles of a column, nulls aside.

    A share lies at rank share * (n - 1): between the values of the whole ranks around it,
    which are found by running counts of the distinct values.
    """
    x = F.col(value).cast("double")
    counts = rows.where(x.isNotNull()).groupBy(*by, x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running(counts, "v", {"upto": "c"}, by)
    sizes = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    ranked = ranked.join(sizes, list(by)) if by else ranked.crossJoin(F.broadcast(sizes))  # one row
    asked = ranked.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    rank = F.col("share") * (F.col("n") - 1)
    low, high, first, last = F.floor(rank), F.ceil(rank), F.col("upto") - F.col("c"), F.col("upto") - 1
    asked = asked.where((high >= first) & (low <= last)).withColumn("part", rank - low)
    at = lambda r: F.max(F.when((r >= first) & (r <= last), F.col("v")))
    found = asked.groupBy(*by, "share").agg(at(low).alias("a"), at(high).alias("b"), F.max("part").alias("part"))
    return found.select(*by, "share", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def _totals(rows: DataFrame, sums: dict[str, str], by: tuple[str, ...]) -> DataFrame:
    """Adds each group's totals to its rows."""
    totals = rows.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return rows.join(totals, list(by)) if by else rows.crossJoin(F.broadcast(totals))  # one row


def auc(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with ties at half; NaN for one class only."""
    steps = running(_steps(rows, by), "score", {"upto": "neg"}, by)
    sums = steps.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    both = F.col("p") * F.col("n")
    return sums.select(*by, F.when(both > 0, F.col("u") / F.when(both > 0, both)).otherwise(float("nan")).alias("auc"))


def average_rank(rows: DataFrame, order: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(…, score, n, avg_rank): the mean rank of each distinct score."""
    counts = running(rows.groupBy(*by, order).agg(F.count(F.lit(1)).alias("n")), order, {"upto": "n"}, by)
    return counts.select(*by, order, "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("avg_rank"))


def _swept(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each distinct score with its counts as a threshold, and ``upto``: how many rows have it or less."""
    steps = running(_steps(rows, by), "score", {"pos_upto": "pos", "neg_upto": "neg"}, by)
    steps = _totals(steps, {"p": "pos", "n": "neg"}, by)
    steps = steps.withColumns({"tp": F.col("p") - F.col("pos_upto") + F.col("pos"), "fp": F.col("n") - F.col("neg_upto") + F.col("neg")})
    steps = steps.withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp"), "upto": F.col("pos_upto") + F.col("neg_upto")})
    return steps.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def sweep(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at each distinct score taken as a threshold."""
    return _swept(rows, by).select(*by, F.col("score").alias("threshold"), "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")


def best_score_threshold(rows: DataFrame, by: tuple[str, ...] = (), most: int = 2048) -> DataFrame:
    """The score with the best F1 as threshold; of equal ones the lowest.

    Beyond ``most`` distinct scores the candidates are that many quantiles of all
    rows, evenly spaced and interpolated. Each needs two neighbouring rows, which are
    found by their rank.
    """
    steps = _swept(rows, by).withColumn("c", F.col("pos") + F.col("neg")).withColumn("one", F.lit(1))
    steps = _totals(steps, {"rows": "c", "scores": "one"}, by)
    last, gaps = F.col("rows") - 1, F.lit(most - 1).cast("long")
    # Candidate i lies at rank i * last / gaps: between the rows of the whole ranks around it.
    low, high = F.col("upto") - F.col("c"), F.col("upto") - 1
    first = lambda rank: F.floor((rank * gaps + last - 1) / last).cast("long")
    within = lambda a, b: F.when(first(a) <= F.least(first(b + 1) - 1, gaps), F.sequence(first(a), F.least(first(b + 1) - 1, gaps))).otherwise(F.array().cast("array<bigint>"))
    own = F.transform(within(low, high), lambda i: F.struct(i.alias("i"), F.lit(0).alias("side")))
    after = F.transform(within(F.greatest(low - 1, F.lit(0)), high - 1), lambda i: F.struct(i.alias("i"), F.lit(1).alias("side")))
    many = steps.where(F.col("scores") > most).select(*by, "score", "f1", "rows", F.explode(F.concat(own, after)).alias("x")).select(*by, "score", "f1", "rows", "x.*")
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    both = many.groupBy(*by, "i").agg(pick("score", 0).alias("s0"), pick("score", 1).alias("s1"), pick("f1", 0).alias("f0"), pick("f1", 1).alias("f1"), F.first("rows").alias("rows"))
    share = (F.col("i") * last % gaps) / gaps
    flat = (share == 0) | F.col("s1").isNull() | (F.col("s1") == F.col("s0"))
    made = both.select(*by, F.when(flat, F.col("s0")).otherwise(F.col("s0") + share * (F.col("s1") - F.col("s0"))).alias("threshold"), F.when(flat, F.col("f0")).otherwise(F.col("f1")).alias("f1"))
    few = steps.where(F.col("scores") <= most).select(*by, F.col("score").alias("threshold"), "f1")
    best = few.unionByName(made).groupBy(*by).agg(F.max(F.struct(F.round("f1", 12).alias("near"), (-F.col("threshold")).alias("low"), F.col("f1").alias("f1"))).alias("b"))
    return best.where("b is not null").select(*by, (-F.col("b.low")).alias("threshold"), "b.f1")


def grid(rows: DataFrame, by: tuple[str, ...] = (), steps: int = 1000, places: int = 12) -> DataFrame:
    """Rates at thresholds 1/steps … (steps-1)/steps.

    Rows are first counted per grid cell; thresholds then see cells, not rows.
    """
    cell = F.least(F.greatest(F.floor(F.round(F.col("score") * steps, places)), F.lit(0)), F.lit(steps)).cast("int")
    cells = rows.withColumn("cell", cell).groupBy(*by, "cell").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg"))
    blank = cells.select(*by).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    full = blank.join(cells, [*by, "cell"], "left").fillna(0, subset=["pos", "neg"])
    down, every = W.partitionBy(*by).orderBy(F.desc("cell")), W.partitionBy(*by)
    full = full.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(every), "n": F.sum("neg").over(every)})
    full = full.where(f"cell between 1 and {steps - 1}").withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")})
    return full.select(*by, (F.col("cell") / steps).alias("threshold"), *[c.alias(n) for n, c in rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()])


def best_grid_threshold(rows: DataFrame, by: tuple[str, ...] = (), near: float = 0.01, steps: int = 1000) -> DataFrame:
    """Among grid thresholds within ``near`` of the best F1, the one nearest 0.5; and that best F1."""
    all_ = grid(rows, by, steps).withColumn("best_f1", F.max("f1").over(W.partitionBy(*by)))
    order = W.partitionBy(*by).orderBy(F.round(F.abs(F.col("threshold") - 0.5), 9), F.desc("f1"), F.desc("recall"), "threshold")
    return all_.where(F.col("f1") >= F.col("best_f1") - near).withColumn("r", F.row_number().over(order)).where("r = 1").select(*by, "threshold", "best_f1")


def elbow(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The score at the knee of the falling curve.

    Scores fall along x from 0 to 1 and are scaled to 0..1; the knee is the first
    with the largest y - (1 - x). Fewer than three scores give the smallest, equal
    ones their value; scores that aren't finite don't count.
    """
    s = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    counts = running(s.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("c")), "score", {"below": "c"}, by)
    span = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    counts = counts.join(span, list(by)) if by else counts.crossJoin(F.broadcast(span))  # one row
    # Among equal scores the last has the largest x.
    x, y = (F.col("n") - F.col("below") + F.col("c") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), (F.col("score") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    gain = F.when((F.col("n") >= 3) & (F.col("hi") > F.col("lo")), F.round(y - (1 - x), 12)).otherwise(-F.col("score"))
    return counts.groupBy(*by).agg(F.max(F.struct(gain.alias("gain"), F.col("score").alias("elbow"))).alias("b")).where("b is not null").select(*by, "b.elbow")


def take_ratio(n: int, ratio: float) -> int:
    """How many of ``n`` a share takes: the ceiling, one at least; all from 1 on, none from 0 down."""
    import math

    return 0 if ratio <= 0 or not n else n if ratio >= 1 else max(1, min(n, math.ceil(n * ratio)))


def best(rows: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` rows with the best scores, ties by id: all above the score at which they are full, and its first ones by number.

    A share of all rows may be asked for, so they are cut off by rank, not sorted in one task.
    """
    if k <= 0:
        return rows.where("false")
    counts = running(rows.groupBy((-F.col("score")).alias("s")).agg(F.count(F.lit(1)).alias("c")), "s", {"upto": "c"})
    full = counts.where(F.col("upto") >= k).agg(F.min("s").alias("s"), F.min_by(F.col("upto") - F.col("c"), "s").alias("above")).first()
    if full["s"] is None:
        return rows
    at, score = -full["s"], F.col("score")
    ties = rows.where(score == at)
    ids = running(ties.groupBy(id_col).agg(F.count(F.lit(1)).alias("c")), id_col, {"upto": "c"})
    some = ids.where(F.col("upto") - F.col("c") < k - full["above"]).select(id_col)
    return rows.where(score > at).unionByName(ties.join(some, id_col, "left_semi"))


def mine_top(rows: DataFrame, ratio: float, id_col: str = "id") -> DataFrame:
    """The best-scored share of rows; ties by id."""
    return best(rows, take_ratio(rows.count(), ratio), id_col)


def mine_top_per(rows: DataFrame, ratio: float, by: tuple[str, ...], id_col: str = "id") -> DataFrame:
    """The best-scored share of each batch."""
    every, order = W.partitionBy(*by), W.partitionBy(*by).orderBy(F.desc("score"), id_col)
    k = F.lit(0) if ratio <= 0 else F.greatest(F.ceil(F.count(F.lit(1)).over(every) * min(ratio, 1.0)), F.lit(1))
    return rows.withColumns({"__k": k, "__r": F.row_number().over(order)}).where("__r <= __k").drop("__k", "__r")


def mine_above(rows: DataFrame, threshold: float, within: tuple[str, ...] = (), least: int = 0, id_col: str = "id") -> DataFrame:
    """Rows scored at least ``threshold``; with ``least``, a batch (``within``) that has fewer gives its best ``least``."""
    fits = F.coalesce(F.col("score") >= threshold, F.lit(False))
    if not least:
        return rows.where(fits)
    order = W.partitionBy(*within).orderBy(F.desc("score"), id_col)
    return rows.withColumn("__r", F.row_number().over(order)).where(fits | (F.col("__r") <= least)).drop("__r")


def hard_negatives(rows: DataFrame, ratio: float, id_col: str = "id") -> DataFrame:
    """The best-scored negatives, as many as ``ratio`` times the positives (halves to even)."""
    n = rows.agg(F.sum((F.col("label") == 1).cast("long"))).first()[0] or 0
    return best(rows.where("label = 0"), round(n * ratio), id_col)


def summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation and quantiles of a column."""
    x, shares = F.col(value), (0.25, 0.5, 0.75, 0.95)
    stats = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(1e-12))).alias("std"))
    cuts = quantiles(rows, value, list(shares), by).groupBy(*by).agg(*[F.max(F.when(F.col("share") == q, F.col("quantile"))).alias(f"p{int(100 * q)}") for q in shares])
    if not by:
        return stats.crossJoin(F.broadcast(cuts))  # one row each
    return stats.join(cuts.select(*[F.col(k).alias(f"__{k}") for k in by], *[f"p{int(100 * q)}" for q in shares]), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]), "left").drop(*[f"__{k}" for k in by])


def standardise(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less their mean, over their deviation (both of the training rows only)."""
    stat = rows.where(train).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", lambda c: F.sqrt(F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(1e-12)))))]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(stat[f"m_{c}"])) / F.lit(stat[f"s_{c}"]) for c in columns})


def corrections(rows: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """From (before, after, label): what a change of scores mends and breaks at a threshold."""
    right = lambda c: (F.col(c) >= threshold).cast("int") == F.col("label")
    fixes, breaks = (F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in (~right("before") & right("after"), right("before") & ~right("after")))
    changed = F.avg(((F.col("before") >= threshold) != (F.col("after") >= threshold)).cast("double"))
    return rows.groupBy(*by).agg(fixes.alias("fixes"), breaks.alias("breaks"), (fixes - breaks).alias("fix_gap"), changed.alias("changed_ratio"))


def hits(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(atom, hit_ratio), with ``any`` for rows where any atom is not zero."""
    hit = lambda c: (F.abs(F.col(c)) > 1e-12).cast("double")
    found = rows.agg(*[F.avg(hit(c)).alias(c) for c in columns], F.avg(F.greatest(*[hit(c) for c in columns]) if len(columns) > 1 else hit(columns[0])).alias("any"))
    return found.unpivot([], [*columns, "any"], "atom", "hit_ratio")
