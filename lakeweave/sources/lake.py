"""Lakes of tables as long cells: (table_name, row_idx, col_idx, column_name, raw).

Profiles and pair scores start from this form. Parquet tables are unpivoted with
their key as row index; CSV tables are read as text with their header, and rows
are numbered from 0 in file order.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import csvscan

CELLS = "table_name string, row_idx long, col_idx int, column_name string, raw string"


@dataclass(frozen=True)
class Table:
    """A table of the lake: its key (row index) and its columns with their SQL as text."""

    name: str
    key: str
    columns: dict[str, str]


def _text(column: str, kind: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,2)) AS STRING)" if kind == "double" else f"CAST({column} AS STRING)"


def unpivot(df: DataFrame, table: Table) -> DataFrame:
    structs = [F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("column_name"), F.expr(_text(c, kind)).alias("raw")) for i, (c, kind) in enumerate(table.columns.items())]
    cells = df.select(F.lit(table.name).alias("table_name"), F.col(table.key).cast("long").alias("row_idx"), F.explode(F.array(*structs)).alias("c"))
    return cells.select("table_name", "row_idx", "c.col_idx", "c.column_name", "c.raw")


def cells(spark: SparkSession, root: str, tables: list[Table]) -> DataFrame:
    """The cells of Parquet tables below ``root``."""
    return reduce(DataFrame.unionByName, [unpivot(spark.read.parquet(f"{root}/{t.name}.parquet"), t) for t in tables])


def counted(spark: SparkSession, root: str, tables: list[Table]) -> DataFrame:
    """(table_name, col_idx, column_name, raw, n, first): every different cell of a column once, how many rows have it and the first of them.

    A column's values are counted as they are stored, so no row is taken apart into cells, each
    column is read by itself, and only different values become text.
    """
    def one(t: Table, i: int, c: str, kind: str) -> DataFrame:
        rows = spark.read.parquet(f"{root}/{t.name}.parquet").select(F.col(t.key).cast("long").alias("row_idx"), F.col(c).alias("value"))
        found = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
        return found.select(F.lit(t.name).alias("table_name"), F.lit(i).alias("col_idx"), F.lit(c).alias("column_name"), F.expr(_text("value", kind)).alias("raw"), "n", "first")

    return reduce(DataFrame.unionByName, [one(t, i, c, kind) for t in tables for i, (c, kind) in enumerate(t.columns.items())])


def cells_sql(tables: list[Table]) -> str:
    """The same in SQL over views of those names."""
    one = lambda t, i, c, k: f"SELECT '{t.name}' AS table_name, CAST({t.key} AS BIGINT) AS row_idx, {i} AS col_idx, '{c}' AS column_name, {_text(c, k).replace('STRING', 'VARCHAR')} AS raw FROM {t.name}"
    return "\nUNION ALL ".join(one(t, i, c, k) for t in tables for i, (c, k) in enumerate(t.columns.items()))


def csv_path(spark: SparkSession, root: str, name: str) -> str | None:
    """Where a table lies by its name, with or without ``.csv``; None, with a warning, if there is no such file."""
    bare = name.removesuffix(".csv")
    jvm = spark.sparkContext._jvm
    for path in dict.fromkeys((f"{root}/{name}", f"{root}/{bare}.csv", f"{root}/{bare}")):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    warnings.warn(f"no file of table {name} below {root}", stacklevel=2)
    return None


def csv_cells(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The cells of CSV tables; a missing file gives none. Headers lose trailing blanks; of equal ones the first counts.

    All files are scanned together, a large one by many tasks. Rows are numbered from 0
    after the header; what a short row lacks is empty, what a long one has more is left out.
    """
    paths = {name.removesuffix(".csv"): path for name in dict.fromkeys(names) if (path := csv_path(spark, root, name))}
    if not paths:
        return spark.createDataFrame([], CELLS)
    found = csvscan.scan(spark, list(paths.values()))
    named = spark.createDataFrame([(path.rsplit("/", 1)[1], name) for name, path in paths.items()], "base_name string, table_name string")
    base = F.regexp_extract("file", "[^/]*$", 0)
    # A file's address is encoded, but for a plus sign.
    found = found.join(F.broadcast(named), F.url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))) == F.col("base_name"))
    headers = found.where("row = 0").select("file", F.transform("fields", lambda h: F.rtrim(h)).alias("names"))
    columns = headers.select("file", F.posexplode("names").alias("at", "column_name"))
    columns = columns.groupBy("file", "column_name").agg(F.min("at").alias("at"))
    columns = columns.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "column_name"))).alias("columns"))
    rows = found.where("row > 0").join(F.broadcast(columns), "file")
    cell = F.transform("columns", lambda c, i: F.struct(i.alias("col_idx"), c["column_name"].alias("column_name"), F.coalesce(F.get("fields", c["at"]), F.lit("")).alias("raw")))
    return rows.select("table_name", (F.col("row") - 1).alias("row_idx"), F.explode(cell).alias("c")).select("table_name", "row_idx", "c.col_idx", "c.column_name", "c.raw")


def required_rows(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only cells of rows that ``wanted`` (table_name, row_idx) names."""
    return cells.join(wanted.select("table_name", "row_idx").distinct(), ["table_name", "row_idx"], "left_semi")
