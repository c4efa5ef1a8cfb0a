"""Monthly trend aggregates over trend rows (month, town, price, count, price_grp).

Plans are one scan and one shuffle each: aggregates are partial on the map
side (HashAggregate partial -> Exchange hashpartitioning(month) -> final),
so a month holding a third of all rows still ships only one partial row per
map task.  Shares are windows over the *aggregated* rows, never over the
input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resalelens.functions.numeric import percent
from resalelens.operators.boxstats import group_quantiles
from resalelens.schemas import HIGH_MEDIAN, MILLION


def median_by_month(trend: DataFrame, value: str = "price", method: str = "sort",
                    accuracy: int = 10000) -> DataFrame:
    """A1: median price per month -> month, median_price.

    ``method`` as in ``operators.boxstats``: ``sort`` (exact, by
    refinement), ``hash`` (Spark ``percentile``: a value->count map per
    month, fastest when prices repeat) or ``approx`` (bounded sketch).
    Months whose prices are all null have a null median.
    """
    q = group_quantiles(trend, value, ["month"], [0.5], ["median_price"], method, accuracy)
    return q.drop("n")


def median_marks(trend: DataFrame, threshold: float = HIGH_MEDIAN, **kw) -> DataFrame:
    """A2: month, median_price, price_bar (1 when the median >= threshold)."""
    med = median_by_month(trend, **kw)
    return med.withColumn(
        "price_bar", F.when(F.col("median_price") >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0)))


def high_median_months(trend: DataFrame, threshold: float = HIGH_MEDIAN, **kw) -> DataFrame:
    """months whose median is at or above ``threshold``."""
    return median_marks(trend, threshold, **kw).where(F.col("price_bar") == 1).select("month", "median_price")


def rows_with_median_mark(trend: DataFrame, threshold: float = HIGH_MEDIAN, **kw) -> DataFrame:
    """Every row with its month's ``price_bar``.

    The marks have one row per calendar month -- a size bound that does not
    grow with the data -- so they are broadcast: the rows are never
    shuffled, and a hot month is not gathered into one task.
    """
    marks = median_marks(trend, threshold, **kw).select("month", "price_bar")
    return trend.join(F.broadcast(marks), "month", "left")


def million_table(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """A3-A5: per month the non-million count (``0``), ``million $ Trans``,
    ``Total Trans`` and ``% million Trans`` (round 2).

    Counts non-null towns like the source, in one conditional aggregation
    instead of group -> pivot -> fill; months without million sales get 0.
    """
    has_town = F.col("town").isNotNull()
    is_mil = F.col("price") >= F.lit(threshold)
    agg = trend.groupBy("month").agg(
        F.count_if(has_town & ~F.coalesce(is_mil, F.lit(False))).alias("0"),
        F.count_if(has_town & F.coalesce(is_mil, F.lit(False))).alias("million $ Trans"),
    )
    total = F.col("0") + F.col("million $ Trans")
    return agg.select(
        "month", "0", "million $ Trans", total.alias("Total Trans"),
        percent(F.col("million $ Trans"), total, 2).alias("% million Trans"),
    )


def million_share(trend: DataFrame, threshold: float = MILLION, from_month: str | None = None) -> DataFrame:
    """Per month ``town`` (non-null count), ``mil`` (million count) and
    ``p_mil`` = round(100 * mil / town, 2); optional ``from_month`` bound."""
    df = trend
    if from_month:
        df = df.where(F.col("month") >= F.lit(from_month))
    mil = F.when(F.col("price") >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0))
    agg = df.groupBy("month").agg(
        F.count("town").alias("town"),
        F.sum(mil).alias("mil"),
    )
    return agg.withColumn("p_mil", percent(F.col("mil"), F.col("town"), 2))


def group_counts(trend: DataFrame) -> DataFrame:
    """Month, price_grp, count (sum of the row counter)."""
    return trend.groupBy("month", "price_grp").agg(F.sum("count").alias("count"))


def month_counts(trend: DataFrame) -> DataFrame:
    """Month, count."""
    return trend.groupBy("month").agg(F.sum("count").alias("count"))


def group_share(trend: DataFrame, digits: int = 1) -> DataFrame:
    """Month, price_grp, count, total, pct = round(100*count/total, digits).

    The month total is a window sum over the aggregated (month, group) rows:
    at most (#months x #groups) rows reach the window, and rows with a null
    month are dropped like the source's inner join drops them.
    """
    counts = group_counts(trend).where(F.col("month").isNotNull())
    total = F.sum("count").over(Window.partitionBy("month"))
    return counts.select(
        "month", "price_grp", "count", total.alias("total"),
    ).withColumn("pct", percent(F.col("count"), F.col("total"), digits))


def group_share_join(trend: DataFrame, digits: int = 1) -> DataFrame:
    """The same shares by joining group counts to month totals."""
    totals = month_counts(trend).withColumnRenamed("count", "total")
    return (group_counts(trend).join(totals, "month")
            .withColumn("pct", percent(F.col("count"), F.col("total"), digits)))


def counts_below_from(trend: DataFrame, threshold: float = HIGH_MEDIAN, digits: int = 1) -> DataFrame:
    """Per month rows below / from ``threshold`` and the share below."""
    below = F.col("price") < F.lit(threshold)
    agg = trend.groupBy("month").agg(
        F.count_if(below).alias("below"),
        F.count_if(~below).alias("at_or_above"),
    )
    return agg.withColumn("pct_below", percent(F.col("below"), F.col("below") + F.col("at_or_above"), digits))


def million_count(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """Number of rows priced at or above ``threshold`` (one row)."""
    return trend.agg(F.count_if(F.col("price") >= F.lit(threshold)).alias("million_count"))


def global_median(trend: DataFrame, value: str = "price", method: str = "sort") -> DataFrame:
    """Median over all rows (one row)."""
    q = group_quantiles(trend.withColumn("_all", F.lit(1)), value, ["_all"], [0.5], ["median_price"], method)
    return q.select("median_price")
