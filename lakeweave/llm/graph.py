"""Connected components of a table of links, by alternating stars.

Each round hangs every node's larger neighbours onto its smallest one (large
star), then its smaller ones (small star), until nothing changes. Links only are
shuffled; per round a table is written to the shared folder, in as few files as
its rows allow, and the driver sees two numbers.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import cached, forget, materialize

#: Links in a file of a round's table.
FILE_ROWS = 200_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    # Dealt anew, so that both sides of the join come from exchanges and a node with very many links can be split.
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).hint("rebalance")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(low, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (two long columns), the root being the smallest node it reaches."""
    a, b = links.columns
    start = cached(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    links, state = start, (start.count(), None)
    for _ in range(most_rounds):
        few = 1 + state[0] // FILE_ROWS
        last, links = links, materialize(_small_star(_large_star(links)).distinct().coalesce(few), "links")
        start.unpersist()
        if last is not start:
            forget(last)
        row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")).first()
        if (row["n"], row["h"]) == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
        state = (row["n"], row["h"])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
