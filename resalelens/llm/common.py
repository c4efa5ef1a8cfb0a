"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resalelens.session import scratch_path

#: ASCII white space; a word is a run of anything else (Java regex text).
SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"
#: Paths of the rows that ``stored`` has written.
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage: whatever is lost later is read from the shared files,
    not computed again, and every later use sees the same rows.  The folder
    is removed through Spark's own filesystem layer when the application ends.
    """
    spark = df.sparkSession
    path = temporary_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the application ends."""
    path = scratch_path(spark, f"llm-{name}")
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: the service owns clean-up
        sc = None
    if sc is not None:
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def discard(*frames: DataFrame) -> None:
    """Deletes the files of ``stored`` rows that nothing reads any more, before the application ends."""
    for df in frames:
        try:
            sc = df.sparkSession.sparkContext
        except Exception:  # noqa: BLE001 -- Spark Connect: the service owns clean-up
            return
        hpath = sc._jvm.org.apache.hadoop.fs.Path(_PLACES[df])
        hpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hpath, True)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(c, _UPPER, _UPPER.lower())


def words(c: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(_TRIM))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def word_count(c: Column) -> Column:
    """Number of words (long), 0 for null."""
    return F.size(words(c)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


#: Bits of a key filter at most: 16 MB, whatever the number of keys.
FILTER_BITS = 1 << 27


class KeyFilter:
    """A bitmap of hashed keys that prunes rows before they are shuffled.

    Rows whose key is surely absent are told apart on the map side: the bitmap
    is broadcast in rows of 4 KB, at most ``FILTER_BITS`` bits in all.  It has
    16 bits a key (one in sixteen absent keys passes) until the bound is
    reached; beyond that it lets more pass, so a full filter prunes nothing and
    every result stays the same.
    """

    def __init__(self, keys: DataFrame, hashed: Column, n: int):
        self.bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * max(n, 1) - 1).bit_length()))
        place = self._place(hashed)
        self.bitmap = keys.groupBy(F.bitmap_bucket_number(place).alias("f_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("f_bits"))

    def _place(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(self.bits)) + 1

    def _marked(self, df: DataFrame, hashed: Column) -> DataFrame:
        at = F.bitmap_bit_position(self._place(hashed))
        byte = F.conv(F.hex(F.substring(F.col("f_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (df.join(F.broadcast(self.bitmap), F.bitmap_bucket_number(self._place(hashed)) == F.col("f_bucket"), "left")
                .withColumn("f_in", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))))

    def maybe(self, df: DataFrame, hashed: Column) -> DataFrame:
        """The rows of ``df`` whose key may be among the keys."""
        return self._marked(df, hashed).where("f_in").select(*df.columns)

    def surely_not(self, df: DataFrame, hashed: Column) -> DataFrame:
        """The other rows of ``df``."""
        return self._marked(df, hashed).where("not f_in").select(*df.columns)
