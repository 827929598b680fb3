"""Reports over runs: means and deviations, pivots, comparisons, logs and their tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W

from ..functions.text import mean_std
from ..sources.shared import parts, written

#: Numbers of an order that are one segment.
SEGMENT = 1 << 16
#: Lines of a training log.
TASK, VALIDATION = r"Training for task:\s*([a-z_]+)", r"\[Validation\]\s+selected threshold=([0-9.]+)\s+f1=([0-9.]+)"


def mean_and_std(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and sample deviation, 0 for a single row."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def macro(rows: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Means per ``inner`` keys, then mean and deviation of these per ``outer`` keys."""
    return mean_and_std(rows.groupBy(*inner).agg(F.avg(value).alias(value)), value, outer)


def cells(stats: DataFrame, places: int = 4) -> DataFrame:
    """Adds ``cell``: ``mean±std``."""
    number = f"%.{places}f"
    return stats.withColumn("cell", F.format_string(f"{number}±{number}", "mean", "std"))


def wide(rows: DataFrame, by: list[str], column: str, values: list, cell: str, missing: str = "N/A") -> DataFrame:
    return rows.groupBy(*by).pivot(column, values).agg(F.first(cell)).fillna(missing)


def compare(one: DataFrame, two: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both runs side by side; a delta only where both have the key."""
    a, b = one.select(*keys, F.col(value).alias("one")), two.select(*keys, F.col(value).alias("two"))
    return a.join(b, keys, "full_outer").withColumn("delta", F.col("two") - F.col("one"))


def strongest(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` best atoms per task by mean AUC, F1, least missing, and name."""
    means = stats.groupBy("task", "atom").agg(F.avg("auc").alias("auc"), F.avg("f1").alias("f1"), F.avg("missing_rate").alias("missing_rate"))
    order = W.partitionBy("task").orderBy(F.desc("auc"), F.desc("f1"), "missing_rate", "atom")
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def carry_forward(lines: DataFrame, value: str, by: list[str], order: str, segment: Column | None = None, n: int | None = None) -> DataFrame:
    """The last value that isn't null up to each line, within its file.

    A file may be of any length: it is cut into segments (by default 65,536 numbers of
    ``order``; any column that grows with it), each is run through by itself, and what
    a segment begins with comes from a row for each segment before it. Segments are dealt
    into ``n`` parts, if that is given.
    """
    known = lines.withColumn("__segment", F.floor(F.col(order) / SEGMENT).cast("long") if segment is None else segment)
    known = known if n is None else known.repartition(n, *by, "__segment")
    inside = F.last(value, ignorenulls=True).over(W.partitionBy(*by, "__segment").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    own = known.groupBy(*by, "__segment").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value)))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(W.partitionBy(*by).orderBy("__segment").rowsBetween(W.unboundedPreceding, -1))
    begins = own.select(*by, "__segment", before.alias("__before"))
    joined = known.withColumn("__inside", inside)
    joined = joined.join(begins, reduce(and_, [joined[k].eqNullSafe(begins[k]) for k in [*by, "__segment"]]), "left").select(*[joined[c] for c in joined.columns], begins["__before"])
    return joined.withColumn(value, F.coalesce("__inside", F.col("__before").getField(value))).select(*lines.columns)


def read_logs(spark, path: str) -> DataFrame:
    """Sections of training logs: (file, section, task, threshold_valbest, val_f1_best, test_f1_valbest, test_f1_at05, auc).

    A section begins where a task is named and goes on to the next; ``section`` orders
    them. Of its validation lines the last counts; a test at 0.5 is one number (the
    last), a test at the validation threshold named last before it the other (the last,
    or where there is none the first test at a threshold of its own); ``auc`` comes from
    the last test. Logs may be of any size: lines are dealt by blocks of their file.
    """
    text = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    got = lambda pattern, k=1: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    number = lambda pattern, k=1: got(pattern, k).try_cast("double")
    tested = r"Test Metrics \(threshold=([0-9.]+)\):\s*(\{.*\})"
    lines = text.select("file", "block", "seq", got(TASK).alias("task"), number(VALIDATION).alias("val_at"), number(VALIDATION, 2).alias("val_f1"), number(tested).alias("test_at"), number(r"Test Metrics.*'link_f1': ([-0-9.e]+)").alias("test_f1"), number(r"Test Metrics.*'link_auc': ([-0-9.e]+)").alias("auc"))
    lines = lines.where(F.coalesce("task", F.col("val_at").cast("string"), F.col("test_at").cast("string")).isNotNull()).withColumn("place", F.struct("block", "seq"))
    # Read once; how many parts follow from how many lines there are.
    lines = written(lines, "lines")
    n = parts(lines)
    lines = lines.withColumn("section", F.when(F.col("task").isNotNull(), F.struct("block", "seq", "task")))
    lines = carry_forward(lines, "section", ["file"], "place", F.col("block"), n).where("section is not null")
    lines = carry_forward(lines.withColumn("at_best", F.col("val_at")), "at_best", ["file", "section"], "place", F.col("block"), n)
    half, fits = F.abs(F.col("test_at") - 0.5) <= 1e-9, F.abs(F.col("test_at") - F.col("at_best")) <= 1e-6
    last = lambda c, when=F.lit(True): F.max_by(c, F.when(F.col(c).isNotNull() & when, F.col("place")))
    first = F.min_by("test_f1", F.when(F.col("test_f1").isNotNull() & ~half, F.col("place")))
    found = lines.repartition(n, "file", "section").groupBy("file", "section").agg(last("val_at").alias("threshold_valbest"), last("val_f1").alias("val_f1_best"), F.coalesce(last("test_f1", ~half & fits), first).alias("test_f1_valbest"), last("test_f1", half).alias("test_f1_at05"), last("auc").alias("auc"))
    return found.select("file", F.struct("section.block", "section.seq").alias("section"), "section.task", "threshold_valbest", "val_f1_best", "test_f1_valbest", "test_f1_at05", "auc")


def read_markdown_table(text: str, spark) -> DataFrame:
    """(key, column, mean, std) of a Markdown table whose first column is a key and whose others are ``mean±std``."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.splitlines() if line.strip().startswith("|")]
    head, body = rows[0], [r for r in rows[1:] if not all(set(c) <= set("-: ") for c in r)]
    flat = [(r[0], h, c) for r in body for h, c in zip(head[1:], r[1:], strict=False)]
    df = spark.createDataFrame(flat, "key string, column string, cell string")
    return df.withColumn("x", mean_std("cell")).select("key", "column", "x.mean", "x.std")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a report's few rows."""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([r.get(c, "") for c in columns]) for r in rows]])


def write_csv(rows: DataFrame, path: str) -> None:
    """A report's few rows as one CSV file with its header, below ``path``."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
