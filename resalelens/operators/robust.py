"""Straight lines that outliers do not bend, and the rows far from them.

A least-squares line gives in to the very rows it should point out: a group of
extreme prices tilts it and widens the spread, and the rows hide each other.
``robust_line`` fits in three steps, none of which moves rows to one task:

1. a resistant line through the medians of the outer thirds of ``x`` (at most a
   sixth of the rows, wherever they lie, can be arbitrary);
2. the scale of its residuals: 1.4826 times their median size;
3. re-weighted least squares with the bisquare weight ``(1 - (r / 4.685 s)^2)^2``,
   zero beyond ``4.685 s``; a round is one aggregate of five sums, and rounds go on until
   neither coefficient moves, ``ROUNDS`` at most.

Medians come from ``operators.quantiles`` (selection by refinement).  The two
columns are written once to the shared folder, so that a pass reads 16 bytes a row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.functions.numeric import round_half_away
from resalelens.operators.common import attach_scalars, stored
from resalelens.operators.quantiles import sorted_quantiles

#: Rounds of re-weighting at most, and the relative move at which they stop.
ROUNDS = 50
STOP = 1e-10
#: Residual size, in scales, from which a row has no weight (95 % efficient on normal errors).
CUT = 4.685
#: Median size of a normal error -> its standard deviation.
MEDIAN_TO_SCALE = 1.4826
#: Residuals up to this share of the largest |y| count as zero where the scale is zero.
_ROUNDING = 1e-9


class Line(NamedTuple):
    """``y = intercept + slope * x`` with the scale of the residuals about it."""

    intercept: float
    slope: float
    scale: float
    rounds: int
    converged: bool


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _median(df: DataFrame, value: Column) -> float:
    return _cuts(df.select(value.alias("v")), "v", [0.5])[0]


def _cuts(df: DataFrame, value: str, ps: list[float]) -> list[float]:
    names = [f"p{i}" for i in range(len(ps))]
    row = sorted_quantiles(df.withColumn("all", F.lit(0)), value, ["all"], ps, names).first()
    return [row[n] for n in names]


def _resistant(xy: DataFrame) -> tuple[float, float]:
    """Slope through the medians of the outer thirds, intercept by the median of what is left."""
    low, high = _cuts(xy, "x", [1 / 3, 2 / 3])
    third = F.when(F.col("x") <= low, 0).when(F.col("x") >= high, 2)
    outer = xy.withColumn("third", third).where("third is not null")
    x = {r["third"]: r["m"] for r in sorted_quantiles(outer, "x", ["third"], [0.5], ["m"]).collect()}
    y = {r["third"]: r["m"] for r in sorted_quantiles(outer, "y", ["third"], [0.5], ["m"]).collect()}
    slope = (y[2] - y[0]) / (x[2] - x[0]) if 2 in x and x[2] > x[0] else 0.0
    return _median(xy, F.col("y") - slope * F.col("x")), slope


def robust_line(df: DataFrame, x: str, y: str, rounds: int = ROUNDS) -> Line | None:
    """The fit over the rows where both are finite numbers; None without such rows.

    Where over half of the rows lie on the resistant line the scale is zero and that line is the
    fit.  Equal ``x`` in both outer thirds start from a level line.  Runs the jobs of five medians and one a round.
    """
    xy = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    xy = stored(xy.where(finite(F.col("x")) & finite(F.col("y"))), "line")
    top = xy.agg(F.max(F.abs("y")).alias("y"), F.avg("x").alias("x")).first()
    if top["y"] is None:
        return None
    a, b = _resistant(xy)
    size = F.abs(F.col("y") - a - b * F.col("x"))
    scale = MEDIAN_TO_SCALE * _median(xy, size)
    if scale <= _ROUNDING * top["y"]:
        return Line(a, b, 0.0, 0, True)
    # About the mean of x, so that the sums keep their digits.
    centred = xy.select((F.col("x") - top["x"]).alias("x"), "y")
    a, done, r = a + b * top["x"], False, 0
    while not done and r < rounds:
        # As a one-row table, not as literals: the generated code is then the same in each round.
        line = df.sparkSession.createDataFrame([(a, b, CUT * scale)], "a double, b double, cut double")
        share = (F.col("y") - F.col("a") - F.col("b") * F.col("x")) / F.col("cut")
        w = F.when(F.abs(share) < 1, F.pow(1 - share * share, 2)).otherwise(0.0)
        s = attach_scalars(centred, line).withColumn("w", w).agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"),
            F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"),
            F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy")).first()
        spread = s["w"] * s["xx"] - s["x"] * s["x"]
        if not spread > 0:
            break
        slope = (s["w"] * s["xy"] - s["x"] * s["y"]) / spread
        level = (s["y"] - slope * s["x"]) / s["w"]
        done = abs(level - a) <= STOP * abs(level) and abs(slope - b) <= STOP * abs(slope)
        a, b, r = level, slope, r + 1
    a -= b * top["x"]
    scale = MEDIAN_TO_SCALE * _median(xy, F.abs(F.col("y") - a - b * F.col("x")))
    return Line(a, b, scale, r, done)


def robust_outliers(df: DataFrame, x: str = "price_sqft", y: str = "price", z_min: float = 3.0) -> DataFrame:
    """N15, robust: every row whose residual from ``robust_line`` is ``z_min`` scales or more.

    Adds ``fitted``, ``residual`` (2 decimals) and ``z`` (4 decimals; infinite where the scale is
    zero and the row is off the line).  Rows without two finite numbers are never outliers; ties
    and repeated rows are all kept; a table without usable rows gives none.
    """
    line = robust_line(df, x, y)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    if line is None:
        fit = z = F.lit(None).cast("double")
    else:
        fit = line.intercept + line.slope * xs
        gap = F.when(F.abs(ys - fit) > _ROUNDING * F.greatest(F.abs(ys), F.abs(fit)), F.signum(ys - fit) * float("inf"))
        z = (ys - fit) / line.scale if line.scale > 0 else gap
    rounded = F.when(F.abs(z) < float("inf"), round_half_away(z, 4)).otherwise(z)
    return df.where(finite(xs) & finite(ys) & (F.abs(z) >= z_min)).select(
        "*", round_half_away(fit, 2).alias("fitted"), round_half_away(ys - fit, 2).alias("residual"), rounded.alias("z"))
