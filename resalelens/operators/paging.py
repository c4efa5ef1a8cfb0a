"""O3: pages of a sorted result, however deep, by a rank index.

The first pages are a top-k: each task keeps ``offset + size`` rows.  For a deep
page that would be most of the table, so its two ends are looked up first:

1. every sort column is one or more *levels*: integer keys whose order, taken one
   level after the other, is the sort order (numbers: ``quantiles.order_key``,
   then the value; texts: seven bytes at a time);
2. at a level, the rows not yet told apart are counted by bracket of their key
   (at most ``BRACKETS`` counts reach the driver), the running count names
   the bracket that holds the wanted rank, and the bracket is cut again until few rows
   are left or they share one key -- then the next level goes on among them;
3. the page is sorted from the rows between the two ends: some thousand, wherever
   the page lies.

Nothing is sorted or moved but these rows; each round is a filtered scan and a partial
aggregate.  Rows that agree in all sort columns are not told apart; a page boundary among
them takes any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalelens.operators.quantiles import bracket, order_key

#: Offsets up to here are a plain top-k.
SHALLOW = 10_000
#: Rows that are sorted around an end of a page, and brackets of a round.
SMALL = 4096
BRACKETS = 1024

_NULL = -(1 << 61)  # before every key
_BYTES = 7

#: A sort column: name, ascending.  Nulls are the smallest values.
SortKey = tuple[str, bool]


def _text_key(c: Column, at: int) -> Column:
    """Bytes ``at``.. of a text as an integer; shorter texts come first."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), at + 1, _BYTES)), 2 * _BYTES, "0"), 16, 10).cast("long")


def _levels(df: DataFrame, key: SortKey) -> Iterator[tuple[Column, bool]]:
    """(expression, whether it is an integer key) of each level of a sort column."""
    name, ascending = key
    c, kind = F.col(name), df.schema[name].dataType

    def signed(k: Column) -> Column:
        k = F.when(c.isNull(), F.lit(_NULL)).otherwise(k)
        return k if ascending else -k

    if isinstance(kind, T.StringType):
        longest = df.agg(F.max(F.octet_length(c))).first()[0] or 0
        for at in range(0, max(longest, 1), _BYTES):
            yield signed(_text_key(c, at)), True
        return
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif not isinstance(kind, (T.NumericType, T.BooleanType)):
        raise TypeError(f"cannot page by {name}: {kind.simpleString()}")
    c_type = "long" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else kind
    number = c.cast("double") if not isinstance(kind, T.BooleanType) else c.cast("int").cast("double")
    yield signed(order_key(number)), True
    if not isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.DateType)):
        yield F.coalesce(c if ascending else -c, F.lit(0).cast(c_type)), False  # numbers that share a key (nulls have their own)


def _end(df: DataFrame, keys: list[SortKey], rank: int) -> tuple[list[tuple[Column, object]], Column, object, object, int]:
    """Where the row of ``rank`` lies: the levels that are settled with their key, the level
    that is not, the lowest and highest key there, and the number of rows before it."""
    settled: list[tuple[Column, object]] = []
    before, scope = 0, df
    for name in keys:
        for level, integer in _levels(scope, name):
            rows = scope.withColumn("__k", level)
            if not integer:
                # Few values share a key.
                counts = rows.groupBy("__k").count().orderBy("__k").collect()
                lo, hi, n, before = _found(((r["__k"], r["__k"], r["count"]) for r in counts), rank, before)
            else:
                lo, hi, n = rows.agg(F.min("__k"), F.max("__k"), F.count(F.lit(1))).first()
                while n > SMALL and lo < hi:
                    cut = (rows.where(F.col("__k").between(lo, hi)).groupBy(bracket(F.col("__k"), F.lit(lo), F.lit(hi), BRACKETS).alias("b"))
                           .agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("b").collect())
                    lo, hi, n, before = _found(((r.lo, r.hi, r.n) for r in cut), rank, before)
            if n <= SMALL or lo != hi:
                return settled, level, lo, hi, before
            settled.append((level, lo))
            scope = scope.where(level == F.lit(lo))
    last = settled.pop()
    return settled, last[0], last[1], last[1], before


def _found(ranges, rank: int, before: int):
    for lo, hi, n in ranges:
        if rank < before + n:
            return lo, hi, n, before
        before += n
    raise ValueError("the rank is beyond the rows")


def _beyond(end, first: bool) -> Column:
    """Rows from the lowest key of an end on (``first``), or up to its highest key."""
    settled, level, lo, hi, _ = end
    out = level >= F.lit(lo) if first else level <= F.lit(hi)
    for key, value in reversed(settled):
        out = (key > F.lit(value) if first else key < F.lit(value)) | ((key == F.lit(value)) & out)
    return out


def sorted_page(df: DataFrame, keys: list[SortKey], offset: int, size: int) -> DataFrame:
    """Rows ``offset``..``offset + size`` of ``df`` sorted by ``keys``, in order; null is the smallest value.

    A page that begins beyond ``SHALLOW`` runs the look-up's jobs now.
    """
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]
    if offset <= SHALLOW:
        return df.orderBy(*order).offset(offset).limit(size)
    total = df.count()
    if offset >= total or size <= 0:
        return df.limit(0)
    first, last = _end(df, keys, offset), _end(df, keys, min(offset + size, total) - 1)
    between = df.where(_beyond(first, True) & _beyond(last, False))
    return between.orderBy(*order).offset(offset - first[4]).limit(size)
