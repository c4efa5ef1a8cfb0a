"""Small plan helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resalelens.session import temporary_path

_KEY = "__one"


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row by
    construction, e.g. ``df.agg(...)`` without grouping) to every row of
    ``df``.

    The single row is broadcast (its size is fixed at one row) and matched
    on a constant key: a hash join, no cartesian product, no shuffle of
    ``df``, and no driver round trip.
    """
    right = one_row.withColumn(_KEY, F.lit(1))
    return df.withColumn(_KEY, F.lit(1)).join(F.broadcast(right), _KEY).drop(_KEY)


def year_of(month_col: str = "month"):
    """``YYYY-MM`` -> ``YYYY`` as int."""
    return F.substring(F.col(month_col), 1, 4).try_cast("int")


def same(left: list[str], right: list[str]):
    """Condition that the columns agree pair by pair, null with null."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage: what is lost later is read from the files.  The folder
    goes when the application ends.
    """
    path = temporary_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
