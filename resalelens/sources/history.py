"""History store + recent months (S3, S4, U1) and projection specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalelens.functions.text import split_names

HISTORY = T.StructType([
    T.StructField("month", T.StringType()),
    T.StructField("town", T.StringType()),
    T.StructField("resale_price", T.DoubleType()),
])


def read_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: every stored document but the store's ``_id``."""
    df = spark.read.format(fmt).load(path)
    return df.drop("_id")


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed empty frame (no untyped columns)."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a declared schema by name; text numbers are parsed leniently,
    missing columns become typed nulls."""
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        src = df.schema[f.name].dataType
        c = F.col(f.name)
        if isinstance(src, T.StringType) and not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        elif src != f.dataType:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def union_history_recent(history: DataFrame, recent: DataFrame, schema: T.StructType = HISTORY,
                         recent_from: str | None = None) -> DataFrame:
    """Bag union of stored history and freshly read months, both cast to
    ``schema``.  Overlapping months are kept twice like the source does,
    unless ``recent_from`` ('YYYY-MM') drops history rows from that month on.
    """
    h = conform(history, schema)
    if recent_from:
        h = h.where(F.col("month") < F.lit(recent_from))
    return h.unionByName(conform(recent, schema))


def projection_spec(spec) -> list[str]:
    """Field names from a DataFrame, a list, or comma text."""
    if isinstance(spec, DataFrame):
        return list(spec.columns)
    if isinstance(spec, str):
        return split_names(spec)
    return list(spec)


def select_spec(df: DataFrame, spec) -> DataFrame:
    """S9 on columns: keep the named columns (all must exist)."""
    names = projection_spec(spec)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"fields not found: {missing}")
    return df.select(*names)


def json_fields_exist(df: DataFrame, json_col: str, spec, keep: list[str] | None = None) -> DataFrame:
    """S9 on a JSON text column: rows whose object has every named field
    (present with a null value counts), projected to those fields as text
    plus the ``keep`` columns."""
    names = projection_spec(spec)
    keys = F.json_object_keys(F.col(json_col))
    cond = F.lit(True)
    for n in names:
        cond = cond & F.coalesce(F.array_contains(keys, n), F.lit(False))
    out = [F.col(c) for c in (keep or [])]
    out += [F.get_json_object(F.col(json_col), f"$.{n}").alias(n) for n in names]
    return df.where(cond).select(*out)
