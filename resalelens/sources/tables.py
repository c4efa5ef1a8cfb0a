"""Plain table reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``<base_dir>/<name>.parquet``; projections and filters applied
    later are pushed into the scan by Catalyst."""
    return spark.read.parquet(table_path(base_dir, name))
