"""Incremental ingest of monthly record pages with Structured Streaming.

The source application refreshes by restarting: it re-fetches the recent
months and appends them to its history.  Here new envelope files landing in
a folder are picked up incrementally:

* ``stream_records`` -- a streaming DataFrame of raw records from JSON
  envelope files (declared schema, no inference);
* ``start_clean_ingest`` -- cleans them (the batch ``clean_transactions``
  operator, unchanged) and appends to the month-partitioned clean table;
  the checkpoint in the shared folder makes each file count exactly once,
  across restarts and lost executors;
* ``start_month_group_counts`` -- keeps per (month, price group) counts up
  to date; the state is one row per (month, group), bounded by the calendar,
  and each micro-batch replaces the small result table.

Run them with ``available_now=True`` for a scheduled refresh (process what
has landed, then stop) or with a processing-time trigger to run
continuously.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from resalelens.operators import clean, trends
from resalelens.schemas import RAW_TXN, envelope_schema
from resalelens.session import checkpoint_dir


def stream_records(spark: SparkSession, landing: str, record_schema: T.StructType = RAW_TXN,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw records of the envelope files arriving under ``landing``."""
    reader = (spark.readStream.schema(envelope_schema(record_schema))
              .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(landing).select(F.inline(F.col("result.records")))


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or os.path.join(checkpoint_dir(spark), "streams", name)


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval or "1 minute")


def start_clean_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str | None = None,
                       available_now: bool = True, interval: str | None = None) -> StreamingQuery:
    """Append cleaned records to the parquet table at ``table`` (partitioned
    by month)."""
    cleaned = clean.clean_transactions(stream_records(spark, landing))
    writer = (cleaned.writeStream.format("parquet").outputMode("append")
              .option("path", table).partitionBy("month")
              .option("checkpointLocation", _checkpoint(spark, "clean-ingest", checkpoint)))
    return _trigger(writer, available_now, interval).start()


def start_month_group_counts(spark: SparkSession, landing: str, table: str,
                             checkpoint: str | None = None, available_now: bool = True,
                             interval: str | None = None) -> StreamingQuery:
    """Maintain ``month, price_grp, count`` for everything landed so far.

    Streaming aggregation in ``complete`` mode keeps one state row per
    (month, group); each micro-batch overwrites the result table."""
    rows = stream_records(spark, landing, T.StructType(
        [T.StructField(c, T.StringType()) for c in ("month", "town", "resale_price")]))
    counts = trends.group_counts(clean.trend_frame(rows))

    def publish(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    writer = (counts.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", _checkpoint(spark, "month-group-counts", checkpoint)))
    return _trigger(writer, available_now, interval).start()
