"""Raw records -> typed, standardised transaction rows (one narrow stage).

Everything here is a per-row projection: no shuffle, fully inside
whole-stage codegen, and Catalyst prunes whatever the caller does not use
(the parquet scan only reads the raw fields that survive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalelens.functions.binning import bin_label, bin_ordinal
from resalelens.functions.text import rewrite_column
from resalelens.schemas import (
    BLOCK_PREFIX,
    FLAT_REWRITES,
    FLOOR_REWRITES,
    LEASE_REWRITES,
    PRICE_BREAKS,
    PRICE_LABELS,
    SQFT_PER_SQM,
    TXN_COLUMNS,
)


def as_double(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double: numbers are cast, text is parsed leniently
    (non-numeric text becomes null instead of failing under ANSI mode)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return c.try_cast("double")
    return c.cast("double")


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename every column by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def clean_transactions(raw: DataFrame, strict_lease: bool = True) -> DataFrame:
    """Standardise raw search records.

    Output columns: month, town, flat, street, floor, lease (text) and
    area_sqm, area_sqft, price_sqm, price_sqft, price (double).

    * lease: first ``s`` dropped, `` year`` -> ``y``, `` month`` -> ``m``
      (first match each, so ``61 years 04 months`` -> ``61y 04ms``);
      ``strict_lease=False`` rewrites every match (``61y 04m``).
    * unit prices are null when the area is 0 or missing.
    * street is ``BLK <block> <street_name>``, null if either part is null.
    """
    area = as_double(raw, "floor_area_sqm")
    price = as_double(raw, "resale_price")
    staged = raw.select(
        F.col("month").cast("string").alias("month"),
        F.col("town").cast("string").alias("town"),
        F.col("flat_type").alias("flat"),
        F.concat(F.lit(BLOCK_PREFIX), F.col("block").cast("string"), F.lit(" "),
                 F.col("street_name")).alias("street"),
        F.col("storey_range").alias("floor"),
        F.col("remaining_lease").alias("lease"),
        area.alias("area_sqm"),
        price.alias("price"),
    )
    staged = rewrite_column(staged, "flat", FLAT_REWRITES)
    staged = rewrite_column(staged, "floor", FLOOR_REWRITES)
    staged = rewrite_column(staged, "lease", LEASE_REWRITES, first_only=strict_lease)
    sqft = F.col("area_sqm") * F.lit(SQFT_PER_SQM)
    return staged.select(
        "month", "town", "flat", "street", "floor", "lease", "area_sqm",
        sqft.alias("area_sqft"),
        F.try_divide(F.col("price"), F.col("area_sqm")).alias("price_sqm"),
        F.try_divide(F.col("price"), sqft).alias("price_sqft"),
        "price",
    ).select(*TXN_COLUMNS)


def trend_frame(raw: DataFrame, breaks=PRICE_BREAKS, labels=PRICE_LABELS,
                from_month: str | None = None, with_ordinal: bool = False) -> DataFrame:
    """Trend rows (P3, P4, P6, X14, F13): month, town, price, count=1, price_grp.

    ``from_month`` (``YYYY-MM``, inclusive) is the lower month bound the
    source meant to apply; by default nothing is filtered.
    """
    price = as_double(raw, "resale_price")
    df = raw
    if from_month:
        df = df.where(F.col("month") >= F.lit(from_month))
    cols = [
        F.col("month").cast("string").alias("month"),
        F.col("town").cast("string").alias("town"),
        price.alias("price"),
        F.lit(1).alias("count"),
        bin_label(price, breaks, labels).alias("price_grp"),
    ]
    if with_ordinal:
        cols.append(bin_ordinal(price, breaks).alias("price_grp_id"))
    return df.select(*cols)
