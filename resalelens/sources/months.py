"""Month keys: generators and filters.

Months are ``YYYY-MM`` text, which sorts chronologically and serves as a
partition column.  No function reads the clock: pass ``as_of``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.schemas import GRACE_DAYS, RECENT_MONTHS


def month_key(c: Column) -> Column:
    """date/timestamp -> ``YYYY-MM``."""
    return F.date_format(c, "yyyy-MM")


def month_sequence(start: Column, end: Column) -> Column:
    """Array of ``YYYY-MM`` from the month of ``start`` to that of ``end``."""
    s, e = F.trunc(start.cast("date"), "MM"), F.trunc(end.cast("date"), "MM")
    return F.transform(F.sequence(s, e, F.expr("interval 1 month")), month_key)


def recent_month_array(as_of: Column, n: int = RECENT_MONTHS, grace_days: int = GRACE_DAYS) -> Column:
    """The last ``n`` months up to the month of ``as_of`` (inclusive),
    one more while ``day(as_of) <= grace_days``."""
    d = as_of.cast("date")
    k = F.when(F.dayofmonth(d) <= F.lit(grace_days), F.lit(n + 1)).otherwise(F.lit(n))
    first = F.trunc(d, "MM")
    return F.transform(F.sequence(F.lit(0), k - 1),
                       lambda i: month_key(F.add_months(first, -(k - 1 - i))))


def month_range(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """S7 as rows: one ``month`` per month between the bound columns."""
    return bounds.select(F.explode(month_sequence(F.col(start), F.col(end))).alias("month"))


def recent_months(anchor: DataFrame, as_of: str = "as_of", n: int = RECENT_MONTHS,
                  grace_days: int = GRACE_DAYS) -> DataFrame:
    """S8 as rows: ``month`` for each recent month of the ``as_of`` column."""
    return anchor.select(F.explode(recent_month_array(F.col(as_of), n, grace_days)).alias("month"))


def filter_months(df: DataFrame, months: Sequence[str] | None = None,
                  from_month: str | None = None) -> DataFrame:
    """F1 + F13: keep listed months and/or months from ``from_month`` on.
    Both are plain predicates on ``month``: partition filters on a
    month-partitioned table."""
    if months is not None:
        df = df.where(F.col("month").isin(list(months)))
    if from_month:
        df = df.where(F.col("month") >= F.lit(from_month))
    return df


def semi_filter_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """F1 with months computed by a query (at most a few rows): a left-semi
    join the planner broadcasts; on a month-partitioned table this enables
    dynamic partition pruning."""
    return df.join(F.broadcast(months.select("month").distinct()), "month", "left_semi")
