"""Profiles of columns, rows and tables from long cells.

Profiles of columns and tables also take counted cells (``lake.counted``), whose ``n`` says how often each is there.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions import text as T

#: Caps of a row's ordered sets (fixed values): values, tokens, fields, characters of its text.
VALUES, TOKENS, FIELDS, CHARS = 64, 128, 48, 512
#: Distinct values of a column that a table profile keeps.
TABLE_VALUES = 1024
#: Parts in which a column's distinct values are ranked.
SALTS = 1024


def _count(cells: DataFrame) -> Column:
    return F.sum("n") if "n" in cells.columns else F.count(F.lit(1))


def _shares(values: DataFrame, *keys: str) -> DataFrame:
    """Counts and ratios per column of a frame with one row for each distinct value, ``n`` times seen."""
    n, numeric = F.sum("n"), F.sum(F.when(T.is_numeric("v"), F.col("n")).otherwise(0))
    return values.groupBy(*keys).agg(
        n.alias("n_values"), F.count(F.lit(1)).alias("n_distinct"), T.ratio(F.count(F.lit(1)), n).alias("unique_ratio"),
        T.ratio(numeric, n).alias("numeric_ratio"), T.ratio(F.sum(F.length("v") * F.col("n")), n).alias("avg_len"),
    )


def join_values(cells: DataFrame) -> DataFrame:
    """(table_name, column_name, v, n): normalised non-empty values. Summed per task before the shuffle, so frequent values cost little."""
    v = cells.withColumn("v", T.normalise(F.coalesce("raw", F.lit(""))))
    return v.where("v <> ''").groupBy("table_name", "column_name", "v").agg(_count(cells).alias("n"))


def _with_headers(columns: DataFrame, stats: DataFrame) -> DataFrame:
    rest = ("n_values", "n_distinct", "unique_ratio", "numeric_ratio", "avg_len")
    joined = columns.join(stats, ["table_name", "column_name"], "left").fillna(0, subset=list(rest))
    return joined.withColumns({"header_tokens": T.header_tokens("column_name"), "header_text": F.lower(F.trim("column_name"))})


def join_columns(cells: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Column profiles for joinability: every non-empty value counts. ``values``: what ``join_values`` gives, if it is there already."""
    columns = cells.select("table_name", "column_name").distinct()
    return _with_headers(columns, _shares(join_values(cells) if values is None else values, "table_name", "column_name"))


def _clean(cells: DataFrame) -> DataFrame:
    v = T.normalise(F.trim(F.coalesce("raw", F.lit(""))))
    return cells.withColumn("v", v).withColumn("missing", T.is_missing("v"))


def schema_counts(cells: DataFrame) -> DataFrame:
    """(table_name, column_name, v, missing, n): every distinct value, those that count as missing too."""
    return _clean(cells).groupBy("table_name", "column_name", "v", "missing").agg(_count(cells).alias("n"))


def schema_values(cells: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, v, n) without values that count as missing."""
    return (schema_counts(cells) if counts is None else counts).where("not missing").select("table_name", "column_name", "v", "n")


def schema_columns(cells: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Column profiles for schema matching, with the share of missing cells (1 for a column without rows). ``counts``: what ``schema_counts`` gives, if it is there already."""
    counts = schema_counts(cells) if counts is None else counts
    columns = counts.groupBy("table_name", "column_name").agg((F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_ratio"))
    return _with_headers(columns, _shares(schema_values(cells, counts), "table_name", "column_name")).fillna(1.0, subset=["missing_ratio"])


def union_values(cells: DataFrame, most: int = TABLE_VALUES) -> DataFrame:
    """(table_name, col_idx, v): the first ``most`` distinct values of each column, in row order.

    A value's first row is found by a combining aggregate; only distinct values are ranked,
    first within ``SALTS`` parts of a column and then what is left of these.
    """
    from pyspark.sql import Window as W

    at = "first" if "first" in cells.columns else "row_idx"
    first = _clean(cells).where("not missing").groupBy("table_name", "col_idx", "v").agg(F.min(at).alias("first"))
    for by in ("part",), ():
        rank = F.row_number().over(W.partitionBy("table_name", "col_idx", *by).orderBy("first", "v"))
        first = first.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS))).withColumn("r", rank).where(F.col("r") <= most)
    return first.select("table_name", "col_idx", "v")


def union_tables(cells: DataFrame) -> DataFrame:
    """Table profiles for unionability: counts and header tokens."""
    columns = cells.select("table_name", "col_idx", "column_name").distinct()
    heads = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_cols"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.header_tokens("column_name"))))).alias("header_tokens"))
    rows = cells.where("col_idx = 0").groupBy("table_name").agg(_count(cells).alias("n_rows"))
    return heads.join(rows, "table_name", "left").fillna(0, subset=["n_rows"])


def row_fields(cells: DataFrame) -> DataFrame:
    """(table_name, row_idx, all): a row's cells in header order, in one group, whose size is the table's width."""
    field = F.struct("col_idx", "column_name", "v", "missing")
    return _clean(cells).groupBy("table_name", "row_idx").agg(F.sort_array(F.collect_list(field)).alias("all"))


def entity_rows(cells: DataFrame) -> DataFrame:
    """Row profiles for entity matching: ordered sets under their caps, a text of the row, counts and a median.

    Also takes what ``row_fields`` gives, if it is there already.
    """
    # A header counts once; its first field wins.
    rows = (cells if "all" in cells.columns else row_fields(cells)).withColumn("f", F.filter("all", lambda x: ~x["missing"]))
    # Words are made once per field, and only if asked for; the columns below put them together.
    heads = F.transform("all", lambda x: F.struct(x["missing"].alias("missing"), T.row_header_tokens(x["column_name"]).alias("h")))
    rows = rows.withColumns({"heads": heads, "t": F.transform("f", lambda x: T.value_tokens(x["v"])), "numeric": F.transform(F.filter("f", lambda x: T.is_numeric(x["v"])), lambda x: x["v"])})
    strings = F.array().cast("array<string>")
    h = F.transform(F.filter("heads", lambda x: ~x["missing"]), lambda x: x["h"])
    per = lambda fn: F.flatten(F.zip_with(h, "t", fn))
    cross = lambda hs, ts: F.flatten(F.transform(hs, lambda h: F.transform(ts, lambda t: F.concat(h, F.lit(":"), t))))
    capped = lambda a, n: F.coalesce(F.slice(F.array_distinct(a), 1, n), strings)
    rows = rows.withColumn("numbers", F.array_sort(F.filter(F.transform("numeric", T.as_number), T.is_finite)))
    n = T.size0("f")
    return rows.select(
        "table_name", "row_idx",
        capped(F.transform("f", lambda x: x["v"]), VALUES).alias("value_set"),
        capped(F.flatten("t"), TOKENS).alias("token_set"),
        capped(F.col("numeric"), VALUES).alias("numeric_value_set"),
        F.array_distinct(F.flatten("heads.h")).alias("header_token_set"),
        capped(per(lambda h, t: F.concat(h, t)), TOKENS).alias("serial_token_set"),
        capped(per(cross), TOKENS).alias("header_value_token_set"),
        F.substring(F.array_join(F.slice(F.transform("f", lambda x: F.concat(F.lit("col "), F.lower(x["column_name"]), F.lit(" val "), x["v"])), 1, FIELDS), " ; "), 1, CHARS).alias("serial_text"),
        n.alias("nonempty_count"),
        T.ratio(T.size0("numeric"), n).alias("numeric_ratio"),
        T.ratio(F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + F.length(x["v"])), n).alias("avg_len"),
        median(F.col("numbers")).alias("numeric_median"),
        F.map_from_entries(F.transform("f", lambda x: F.struct(F.lower(x["column_name"]), x["v"]))).alias("header_to_value"),
    )


def median(s):
    """The median of a sorted array; null of an empty one."""
    n = F.size(s)
    middle = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (middle(F.floor((n + 1) / 2)) + middle(F.floor(n / 2) + 1)) / 2)


def idf(rows: DataFrame) -> DataFrame:
    """(token, df, idf) over row profiles with a token at least: ln((N + 1) / (df + 1)) + 1."""
    n = rows.where(F.size("token_set") > 0).agg(F.count(F.lit(1)).alias("n_rows"))
    df = rows.select(F.explode("token_set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.select("token", "df", (F.log((n.scalar() + 1) / (F.col("df") + 1)) + 1).alias("idf"))
