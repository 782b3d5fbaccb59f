"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import HOT_ROWS, drop, hot_join, written


def _joined(rows: DataFrame, least: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """rows with the least neighbour of their u. Among n links there is no node of more than 2 n, so few links have no hot one."""
    return rows.join(least.drop("degree"), "u") if 2 * n <= hot_rows else hot_join(rows, written(least, "components-least"), "u", "degree", hot_rows)


def _large(edges: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return _joined(both.filter("v > u"), least, n, hot_rows).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    joined = _joined(down, least, n, hot_rows)
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, label) for every node of the links (u, v): the least node that is reachable.

    Every round is written to the shared folder; only a count and a checksum reach the driver. The
    number of rounds follows the logarithm of the longest path, not the size of a component. The links
    of a node with more than hot_rows of them are joined by broadcast of that node alone.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), name)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head()
        if mark == before or not mark[0]:
            break
        before = mark
        after = written(_small(_large(now, mark[0], hot_rows), mark[0], hot_rows), name)
        drop(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
