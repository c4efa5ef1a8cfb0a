"""Distinct facets for selectors (A17-A19) and array-tag facets.

Facets are small by nature (towns, months, bins, tags): they are computed
as distributed aggregates; ``*_list`` helpers collect the final small
result for a UI and say so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resalelens.operators.common import attach_scalars
from resalelens.schemas import ALL_TOWNS


def town_facets(df: DataFrame, all_label: str = ALL_TOWNS) -> DataFrame:
    """Town, pos -- the wildcard first (pos 0), then towns sorted."""
    towns = df.where(F.col("town").isNotNull()).select("town").distinct()
    ranked = towns.select("town", F.row_number().over(Window.orderBy("town")).alias("pos"))
    # The wildcard row is produced from the data as well (one row per run).
    wildcard = towns.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(all_label).alias("town"), F.lit(0).alias("pos"))
    return wildcard.unionByName(ranked)


def month_facets(df: DataFrame) -> DataFrame:
    """Month, pos -- distinct months in chronological order."""
    months = df.where(F.col("month").isNotNull()).select("month").distinct()
    return months.select("month", F.row_number().over(Window.orderBy("month")).alias("pos"))


def bin_facets(trend: DataFrame) -> DataFrame:
    """price_grp_id, price_grp present in the data (sorted by id)."""
    return (trend.where(F.col("price_grp").isNotNull())
            .select("price_grp_id", "price_grp").distinct())


def facet_list(df: DataFrame, col: str, order: str = "pos") -> list:
    """Collect a facet column in order (driver-side; facets are small)."""
    return [r[0] for r in df.orderBy(order).select(col).collect()]


def tag_counts(posts: DataFrame) -> DataFrame:
    """Tag, n (posts carrying the tag)."""
    return (posts.select(F.explode(F.array_distinct("tags")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def tag_rows(posts: DataFrame, tag: str) -> DataFrame:
    """R2: posts carrying ``tag`` with ``n`` = how many there are."""
    rows = posts.where(F.array_contains("tags", tag))
    return attach_scalars(rows, rows.agg(F.count(F.lit(1)).alias("n")))


def recent(posts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most recent published posts (top-n report; post_id
    breaks date ties)."""
    return posts.where(F.col("published")).orderBy(F.col("date").desc(), F.col("post_id").desc()).limit(n)
