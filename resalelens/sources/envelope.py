"""JSON response envelopes ``{"result": {"records": [...]}}``.

Envelopes are written one per line (JSON Lines), so files stay splittable
and any number of executors can read one month; each envelope holds at
most ``page_size`` records, like one page of the source API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalelens.schemas import RAW_TXN, envelope_schema

#: Tasks that the pages of one month are dealt to at most.
SHARES = 32


def read_envelopes(spark: SparkSession, path: str, record_schema: T.StructType = RAW_TXN,
                   multi_line: bool = False) -> DataFrame:
    """Records of every envelope under ``path`` with a declared schema
    (no inference).  An envelope with no or empty ``records`` gives no rows.
    Month sub-folders (``month=YYYY-MM``) are not added as a column: the
    records carry their month."""
    env = (spark.read.schema(envelope_schema(record_schema))
           .option("multiLine", multi_line)
           .option("recursiveFileLookup", "true")
           .json(path))
    return env.select(F.inline(F.col("result.records")))


def write_envelopes(df: DataFrame, path: str, page_size: int = 10000,
                    partition_by: str | None = "month", as_text: bool = True, compression: str = "gzip") -> None:
    """Write rows as envelopes of at most ``page_size`` records.

    A page is a run of consecutive rows of one input partition and one month
    (``monotonically_increasing_id`` is partition-local).  The rows are shuffled
    once, by month and share -- a hash of the page, so that no month is in one
    task -- and pages are built and written where they arrive: a month has
    ``SHARES`` files at most.  Page numbers follow the input order, which is
    stable for inputs read from files (a recomputed task numbers its rows the
    same way).  ``as_text`` renders every field as text, like the source API
    does; the files are compressed, since field names make up most of them.
    """
    rec = F.struct(*[(F.col(c).cast("string") if as_text else F.col(c)).alias(c) for c in df.columns])
    page = F.floor(F.monotonically_increasing_id() / F.lit(page_size)).alias("_page")
    keys = [F.col(partition_by), page] if partition_by else [page]
    rows, by = df.select(*keys, rec.alias("_rec")), ["_page"]
    if partition_by:
        rows, by = rows.withColumn("_share", F.pmod(F.xxhash64("_page"), F.lit(SHARES))), [partition_by, "_share", "_page"]
        rows = rows.repartition(partition_by, "_share")  # the grouping needs no other shuffle
    env = rows.groupBy(*by).agg(F.struct(F.collect_list("_rec").alias("records")).alias("result")).drop("_share", "_page")
    out = env.write.mode("overwrite").option("compression", compression)
    (out.partitionBy(partition_by) if partition_by else out).json(path)


def records_json(df: DataFrame) -> DataFrame:
    """S6 in-row form: one JSON object text per row (``to_dicts`` equivalent)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    """Write rows as JSON Lines."""
    df.write.mode("overwrite").json(path)
