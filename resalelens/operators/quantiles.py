"""Exact per-group quantiles by refinement.

A quantile needs the values at one or two ranks of its group.  Those are found
without ever sorting a group:

1. one aggregate gives each group's number of values and the range they lie in;
2. a range of more than ``SMALL`` rows is cut into ``BRACKETS`` equal brackets
   and its rows are counted by bracket -- a partial aggregate, so a task ships at
   most ``BRACKETS`` counts a range however many rows it has.  Running counts over
   the brackets tell which of them hold a wanted rank; only those (narrowed to
   the values in them) are left, and step 2 repeats until every range is small or
   holds one value;
3. the rows of the remaining ranges are counted by value, and running counts
   over these few values give the values at the wanted ranks.

Brackets are not cut on the values but on ``order_key``, a 62-bit integer
that grows with the value and has equal room for each power of two, so
1e-300 and 1e300 in one group cost a round or two, not hundreds.  Each round
divides a range by ``BRACKETS``: one round up to four million rows a group, two up
to four billion.  Windows see at most ``BRACKETS`` brackets, or ``SMALL`` rows' values,
of a range; rows are never shuffled by their group.

The ranges -- a few rows a group -- are written to the shared folder after each round,
which also cuts the lineage.  Null values count for nothing, but their group stays:
``n = 0`` and null quantiles.  NaN is greater than any number, as elsewhere in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resalelens.operators.common import same, stored

#: Brackets of a range in a round, and rows up to which a range is counted by value.
BRACKETS = 1024
SMALL = 4096

_SCALE = float(1 << 50)
_TOP = 2_800_000_000_000_000_000  # infinity; beyond every finite value's key
_NAN = 3_000_000_000_000_000_000


def order_key(value: Column) -> Column:
    """A long that never falls as the double ``value`` rises; null for null.

    Some 1,000 neighbouring doubles share a key at most.
    """
    size = F.abs(value)
    # The exponent may come out one too high next to a power of two; the key stays monotone.
    exponent = F.least(F.floor(F.log2(size)).cast("double"), F.lit(1023.0))
    finite = ((exponent + 1075 + (size / F.pow(F.lit(2.0), exponent) - 1)) * _SCALE).cast("long")
    key = F.when(size == float("inf"), F.lit(_TOP)).when(size == 0, F.lit(0)).otherwise(finite)
    return F.when(F.isnan(value), F.lit(_NAN)).when(value < 0, -key).otherwise(key)


def _names(ps: Sequence[float]) -> list[str]:
    return [f"q{i}" for i in range(len(ps))]


def _position(n, p: float, definition: str):
    """0-based fractional rank of the ``p``-quantile among ``n`` values."""
    nd = n.cast("double")
    if definition == "linear":   # (n-1)p: quantile_cont / percentile
        return (nd - 1) * F.lit(float(p))
    if definition == "hazen":    # 1-based n*p + 1/2, clamped to the sample
        return F.least(F.greatest(nd * F.lit(float(p)) - F.lit(0.5), F.lit(0.0)), nd - 1)
    raise ValueError("definition must be 'linear' or 'hazen'")


def bracket(key: Column, low: Column, high: Column, brackets: int) -> Column:
    """Number of the bracket of ``low``..``high`` that holds ``key``, in exact integer arithmetic."""
    return F.call_function("div", key - low, F.call_function("div", high - low, F.lit(brackets)) + 1)


def _refined(keyed: DataFrame, ranges: DataFrame, groups: list[str]) -> DataFrame:
    """The brackets of ``ranges`` that hold a wanted rank, as ranges.

    The rows are counted in fixed-size buffers (a hash aggregate); the ranks, an array, join the
    counts afterwards -- as an aggregate of their own they would have all rows of a task sorted.
    """
    counts = (_inside(keyed, ranges, groups).select(*groups, "k", "lo", "hi")
              .groupBy(*groups, "lo", bracket(F.col("k"), F.col("lo"), F.col("hi"), BRACKETS).alias("b"))
              .agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("lo_"), F.max("k").alias("hi_")))
    of = ranges.select(*[F.col(c).alias(f"r_{c}") for c in [*groups, "lo"]], "below", "ranks", "n")
    cut = counts.join(of, same([*groups, "lo"], [f"r_{c}" for c in [*groups, "lo"]])).drop(*[f"r_{c}" for c in [*groups, "lo"]])
    upto = F.col("below") + F.sum("rows").over(Window.partitionBy(*groups, "lo").orderBy("b"))
    return (cut.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("rows"))
            .withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("upto"))))
            .where(F.size("ranks") > 0)
            .select(*groups, F.col("lo_").alias("lo"), F.col("hi_").alias("hi"), "below", "rows", "n", "ranks"))


def _inside(keyed: DataFrame, ranges: DataFrame, groups: list[str]) -> DataFrame:
    """The rows that lie in a range of their group, with the range's columns.

    The ranges are small; how they meet the rows is left to the planner's size check.
    """
    r = ranges.select(*[F.col(c).alias(f"r_{c}") for c in groups], "lo", "hi", "below", "n", "ranks")
    on = same(groups, [f"r_{c}" for c in groups]) & F.col("k").between(F.col("lo"), F.col("hi"))
    return keyed.join(r, on).drop(*[f"r_{c}" for c in groups])


def sorted_quantiles(df: DataFrame, value: str, groups: Sequence[str], ps: Sequence[float],
                     names: Sequence[str] | None = None, definition: str = "linear") -> DataFrame:
    """Per group: ``n`` (non-null values) and one column per ``p`` in ``ps``,
    interpolated linearly between the order statistics around the position
    given by ``definition``: ``linear`` = (n-1)p (``quantile_cont``), or
    ``hazen`` = n*p + 1/2 (1-based).  Runs a job for each round of refinement."""
    g = [f"g{i}" for i in range(len(groups))]
    names = list(names or _names(ps))
    keyed = df.select(*[F.col(c).alias(k) for c, k in zip(groups, g)], F.col(value).cast("double").alias("v")).withColumn(
        "k", order_key(F.col("v")))
    ends = [end(_position(F.col("n"), p, definition)).cast("long") for p in ps for end in (F.floor, F.ceil)]
    sizes = stored(keyed.groupBy(*g).agg(F.count("v").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")), "sizes")
    ranges = sizes.where("n > 0").select(*g, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("rows"), "n",
                                         F.array_distinct(F.array(*ends)).alias("ranks"))
    wide = (F.col("rows") > SMALL) & (F.col("lo") < F.col("hi"))
    while not (more := ranges.where(wide)).isEmpty():
        ranges = stored(_refined(keyed, more, g).unionByName(ranges.where(~wide)), "ranges")
    counts = _inside(keyed, ranges, g).groupBy(*g, "lo", "v").agg(
        F.count(F.lit(1)).alias("c"), F.first("below").alias("below"), F.first("n").alias("n"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*g, "lo").orderBy("v"))
    found = counts.withColumn("upto", upto).groupBy(*g).agg(
        *[F.min(F.when(F.col("upto") > end, F.col("v"))).alias(f"e{i}") for i, end in enumerate(ends)])
    found = found.select(*[F.col(c).alias(f"f_{c}") for c in g], *[f"e{i}" for i in range(len(ends))])
    out = [*[F.col(k).alias(c) for c, k in zip(groups, g)], F.col("n")]
    for i, (name, p) in enumerate(zip(names, ps)):
        pos = _position(F.col("n"), p, definition)
        lo, hi = F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}")
        out.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return sizes.join(found, same(g, [f"f_{c}" for c in g]), "left").select(*out)
