"""Declared schemas, column names and fixed values.

No schema is inferred on the library path: raw records are read with the
string schema below and cast explicitly by ``operators.clean``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's for equal results)
# ---------------------------------------------------------------------------

# Raw field list requested per month, in request order.
RAW_FIELDS = [
    "month", "block", "town", "flat_type", "street_name", "storey_range",
    "floor_area_sqm", "remaining_lease", "resale_price",
]

# Fields of the trend feed.
TREND_FIELDS = ["month", "town", "resale_price"]

# Clean transaction columns, in output order.
TXN_COLUMNS = [
    "month", "town", "flat", "street", "floor", "lease",
    "area_sqm", "area_sqft", "price_sqm", "price_sqft", "price",
]

# Square feet per square metre.
SQFT_PER_SQM = 10.7639

# First-match text rewrites: (column, literal, replacement), applied in order.
LEASE_REWRITES = [("s", ""), (" year", "y"), (" month", "m")]
FLAT_REWRITES = [(" ROOM", "RM"), ("EXECUTIVE", "EC"), ("MULTI-GENERATION", "MG")]
FLOOR_REWRITES = [(" TO ", "-")]

# Street column = this prefix + block + " " + street name.
BLOCK_PREFIX = "BLK "

# Price groups: left-closed intervals [lo, hi) between these breaks.
PRICE_BREAKS = [300000, 500000, 800000, 1000000]
PRICE_LABELS = ["0-300k", "300-500k", "500-800k", "800k-1m", ">=1m"]

# Thresholds.
MILLION = 1000000
HIGH_MEDIAN = 500000

# Months kept by the search load: the last 6, or 7 up to this day of month.
RECENT_MONTHS = 6
GRACE_DAYS = 10

# Wildcard town.
ALL_TOWNS = "All"

# Box plot fence factor (IQR multiple).
FENCE_K = 1.5

# Retirement age used by the lease coverage rule (lease >= AGE_TARGET - age).
AGE_TARGET = 95

# WGS-84 ellipsoid and mean earth radius (metres).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_M = 6371008.8

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

RAW_TXN = T.StructType([T.StructField(c, T.StringType()) for c in RAW_FIELDS])

RAW_TREND = T.StructType([T.StructField(c, T.StringType()) for c in TREND_FIELDS])

TXN = T.StructType(
    [T.StructField(c, T.StringType()) for c in TXN_COLUMNS[:6]]
    + [T.StructField(c, T.DoubleType()) for c in TXN_COLUMNS[6:]]
)

TREND = T.StructType([
    T.StructField("month", T.StringType()),
    T.StructField("town", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("price_grp", T.StringType()),
])


def envelope_schema(record_schema: T.StructType) -> T.StructType:
    """``{"result": {"records": [ {...}, ... ]}}`` around a record schema."""
    return T.StructType([
        T.StructField("result", T.StructType([
            T.StructField("records", T.ArrayType(record_schema)),
        ])),
    ])


POI = T.StructType([
    T.StructField("loc_info", T.StringType()),
    T.StructField("LATITUDE", T.DoubleType()),
    T.StructField("LONGITUDE", T.DoubleType()),
])

POST = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("published", T.BooleanType()),
    T.StructField("title", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])
