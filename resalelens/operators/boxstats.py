"""Box-plot statistics, percentile cutoffs and outliers.

Quartiles use linear interpolation between order statistics (Spark
``percentile``, the same definition as ``quantile_cont``), fences sit at
``k * IQR`` outside the quartiles and each whisker ends at the most extreme
value still inside its fence.

Plan: pass 1 computes the quartiles per group (see ``method``);
its result has one row per group and is joined back to the rows on the
group key -- the planner broadcasts it when its estimate is small and
shuffles otherwise, and AQE splits a skewed group across tasks.  Pass 2
aggregates again for whiskers and outlier counts, a buffer a group in each task.  No pass gathers a group.

``method`` picks how quantiles are computed:

* ``"sort"`` (default): exact, by refinement of the ranges that hold the
  wanted ranks (``operators.quantiles``; runs a job a round);
* ``"hash"``: exact, Spark's ``percentile`` (fastest when groups have few
  distinct values; its final merge keeps a group's distinct values in one
  task);
* ``"approx"``: ``percentile_approx`` with ``accuracy`` (bounded memory).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resalelens.functions.numeric import round_half_away
from resalelens.operators.common import same, stored
from resalelens.operators.quantiles import sorted_quantiles
from resalelens.schemas import FENCE_K


METHODS = ("sort", "hash", "approx")


def group_quantiles(df: DataFrame, value: str, groups: Sequence[str], ps: Sequence[float],
                    names: Sequence[str], method: str = "sort", accuracy: int = 10000,
                    definition: str = "linear") -> DataFrame:
    """Per group: ``n`` (non-null values) and one column per quantile.
    ``definition="hazen"`` (plotting positions n*p + 1/2) needs ``method="sort"``."""
    if method == "sort":
        return sorted_quantiles(df, value, groups, ps, names, definition)
    if definition != "linear":
        raise ValueError("only method='sort' supports definition='hazen'")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    v = F.col(value).cast("double")
    arr = F.array(*[F.lit(float(p)) for p in ps])
    agg = F.percentile(v, arr) if method == "hash" else F.percentile_approx(v, arr, F.lit(accuracy))
    q = df.groupBy(*groups).agg(F.count(v).alias("n"), agg.alias("_q"))
    return q.select(*groups, "n", *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])


def quartiles(df: DataFrame, value: str, groups: Sequence[str], method: str = "sort",
              accuracy: int = 10000, definition: str = "linear") -> DataFrame:
    """Per group: n, q1, median, q3 (nulls in ``value`` ignored)."""
    return group_quantiles(df, value, groups, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                           method, accuracy, definition)


def fences(df: DataFrame, value: str, groups: Sequence[str], k: float = FENCE_K, **kw) -> DataFrame:
    """Quartiles plus iqr, lower_fence and upper_fence."""
    q = quartiles(df, value, groups, **kw)
    iqr = F.col("q3") - F.col("q1")
    return q.select("*", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(k) * iqr).alias("lower_fence"),
                    (F.col("q3") + F.lit(k) * iqr).alias("upper_fence"))


def box_stats(df: DataFrame, value: str, groups: Sequence[str], k: float = FENCE_K,
              digits: int | None = None, **kw) -> DataFrame:
    """Per group n, q1, median, q3, iqr, fences, whiskers, n_outliers.

    The fences, a row a group, are written to the shared folder, so that the planner knows their
    size; each row meets them where it is read, and a task holds one buffer a group, however many
    values there are.  ``digits`` rounds the statistics.
    """
    groups = list(groups)
    stats = ["n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence"]
    g, fg = [f"g{i}" for i in range(len(groups))], [f"f{i}" for i in range(len(groups))]
    f = stored(fences(df, value, groups, k, **kw).toDF(*fg, *stats), "fences")
    # -0.0 + 0.0 is 0.0
    rows = df.select(*[F.col(c).alias(x) for c, x in zip(groups, g)], (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    v = F.col("v")
    inside = v.between(F.col("lower_fence"), F.col("upper_fence"))
    out = rows.join(f, same(g, fg)).groupBy(*g).agg(
        *[F.first(c).alias(c) for c in stats],
        F.min(F.when(inside, v)).alias("lower_whisker"),
        F.max(F.when(inside, v)).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    ).withColumnsRenamed(dict(zip(g, groups)))
    if digits is not None:
        rounded = stats[1:] + ["lower_whisker", "upper_whisker"]
        out = out.select(*[round_half_away(c, digits).alias(c) if c in rounded else F.col(c)
                           for c in out.columns])
    return out.select(*groups, *stats, "lower_whisker", "upper_whisker", "n_outliers")


def outliers(df: DataFrame, value: str, groups: Sequence[str], k: float = FENCE_K, **kw) -> DataFrame:
    """The rows outside their group's fences (all input columns kept)."""
    groups = list(groups)
    f = fences(df, value, groups, k, **kw).select(*groups, "lower_fence", "upper_fence")
    v = F.col(value)
    return (df.join(f, groups)
            .where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))
            .drop("lower_fence", "upper_fence"))


def cutoff(df: DataFrame, value: str, groups: Sequence[str], p: float = 0.1, method: str = "sort",
           accuracy: int = 10000, name: str = "cutoff") -> DataFrame:
    """A10: per group the ``p``-quantile of ``value``."""
    q = group_quantiles(df, value, groups, [p], [name], method, accuracy)
    return q.drop("n")


def at_or_below_cutoff(df: DataFrame, value: str, groups: Sequence[str], p: float = 0.1,
                       broadcast_cutoffs: bool = False, **kw) -> DataFrame:
    """Rows whose value is at or below their group's ``p``-quantile,
    with the cutoff attached.  Set ``broadcast_cutoffs`` only when the
    number of groups has a fixed bound (e.g. calendar months); otherwise the
    planner chooses the join from measured sizes."""
    groups = list(groups)
    c = cutoff(df, value, groups, p, **kw)
    if broadcast_cutoffs:
        c = F.broadcast(c)
    return df.join(c, groups).where(F.col(value) <= F.col("cutoff"))
