"""Published analyses (N1-N20) as DataFrame operators.

Inputs are clean transactions (``txn``: month, town, flat, street, floor,
lease, area_*, price_*, price) or trend rows (month, town, price, ...).
Windows only ever run over aggregated rows (months, towns, years), never
over input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resalelens.functions.numeric import percent, round_half_away
from resalelens.functions.text import lease_years, storey_low
from resalelens.operators import boxstats
from resalelens.operators.common import attach_scalars, year_of
from resalelens.schemas import AGE_TARGET, MILLION

ALL = "All"


def _is_mil(threshold: float):
    return F.coalesce(F.col("price") >= F.lit(threshold), F.lit(False))


def with_year_count(txn: DataFrame) -> DataFrame:
    if "year_count" in txn.columns:
        return txn
    return txn.withColumn("year_count", lease_years(F.col("lease")))


# -- N1, N2, N16, N17, N18: monthly / half-yearly million counts -------------

def million_by_month(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """month, million, rest."""
    m = _is_mil(threshold)
    return trend.groupBy("month").agg(F.count_if(m).alias("million"), F.count_if(~m).alias("rest"))


def monthly_million_periods(trend: DataFrame, split_month: str, labels=("before", "after"),
                            threshold: float = MILLION) -> DataFrame:
    """Month, period, million -- months before ``split_month`` in the first
    period, after it in the second, the split month in both."""
    per = million_by_month(trend, threshold)
    m = F.col("month")
    periods = F.filter(F.array(F.when(m <= F.lit(split_month), F.lit(labels[0])),
                               F.when(m >= F.lit(split_month), F.lit(labels[1]))),
                       lambda x: x.isNotNull())
    return per.select("month", F.explode(periods).alias("period"), "million")


def million_percent_rest(trend: DataFrame, threshold: float = MILLION, digits: int = 2) -> DataFrame:
    """Month, million, rest, pct = 100 * million / (million + rest)."""
    per = million_by_month(trend, threshold)
    return per.withColumn("pct", percent(F.col("million"), F.col("million") + F.col("rest"), digits))


def record_months(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """Month, million, prev_max (highest earlier month), is_record.

    The running max is a window over the monthly aggregate (one row per
    month), so its single ordered partition stays small at any data size.
    """
    per = million_by_month(trend, threshold).select("month", "million")
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max("million").over(w)
    return per.select("month", "million", prev.alias("prev_max"),
                      (prev.isNull() | (F.col("million") > prev)).alias("is_record"))


def half_year_share(trend: DataFrame, threshold: float = MILLION, digits: int = 2) -> DataFrame:
    """Year, half (H1/H2), count, million, pct."""
    half = F.when(F.substring("month", 6, 2) <= F.lit("06"), F.lit("H1")).otherwise(F.lit("H2"))
    agg = (trend.where(F.col("month").isNotNull())
           .groupBy(year_of().alias("year"), half.alias("half"))
           .agg(F.count(F.lit(1)).alias("count"), F.count_if(_is_mil(threshold)).alias("million")))
    return agg.withColumn("pct", percent(F.col("million"), F.col("count"), digits))


# -- N3, N4: town x year --------------------------------------------------------

def town_year_counts(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """Million-dollar sales per (town, year) (non-empty cells only)."""
    return (trend.where(F.col("price") >= F.lit(threshold))
            .groupBy("town", year_of().alias("year")).agg(F.count(F.lit(1)).alias("count")))


def town_year_crosstab(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """N3 (long form): town, year, count with ``All`` margins for both keys
    and ``town_total`` for ordering towns by total, descending.

    ``cube`` computes every margin in one aggregation; ``grouping()`` tells
    a margin apart from a null key.  Empty cells are absent.
    """
    mil = trend.where(F.col("price") >= F.lit(threshold)).select("town", year_of().cast("string").alias("year"))
    cube = mil.cube("town", "year").agg(
        F.count(F.lit(1)).alias("count"), F.grouping("town").alias("gt"), F.grouping("year").alias("gy"))
    long = cube.select(
        F.when(F.col("gt") == 1, F.lit(ALL)).otherwise(F.col("town")).alias("town"),
        F.when(F.col("gy") == 1, F.lit(ALL)).otherwise(F.col("year")).alias("year"),
        "count",
        F.col("gy"),
    )
    # Town totals over the cube output (towns x years rows, not input rows).
    total = F.max(F.when(F.col("gy") == 1, F.col("count"))).over(Window.partitionBy("town"))
    return long.select("town", "year", "count", total.alias("town_total"))


#: Year columns of a wide cross-tab at most.
MOST_YEARS = 200


def crosstab_wide(long: DataFrame, years: Sequence[str] | None = None, most_years: int = MOST_YEARS) -> DataFrame:
    """Pivot the long cross-tab to one column per year plus ``All``.

    ``years`` names the columns; without it they are the years of the data, found by
    an aggregate over the cross-tab (towns x years rows).  More than ``most_years`` of them
    are an error: no year is left out.
    """
    if years is None:
        found = long.where(F.col("year") != ALL).select("year").distinct().limit(most_years + 1).collect()
        if len(found) > most_years:
            raise ValueError(f"more than {most_years} years: name the columns")
        years = sorted(r.year for r in found)
    values = [str(y) for y in years] + [ALL]
    return (long.groupBy("town", "town_total").pivot("year", values).agg(F.first("count"))
            .orderBy(F.col("town_total").desc(), "town"))


def town_year_change(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """Town, year, count, prev_count (previous year with sales), change."""
    c = town_year_counts(trend, threshold)
    prev = F.lag("count").over(Window.partitionBy("town").orderBy("year"))
    return c.select("town", "year", "count", prev.alias("prev_count"),
                    (F.col("count") - prev).alias("change"))


def first_million_year(trend: DataFrame, threshold: float = MILLION) -> DataFrame:
    """Town, first year with a million-dollar sale."""
    return (trend.where(F.col("price") >= F.lit(threshold)).groupBy("town")
            .agg(F.min(year_of()).alias("first_year")))


# -- N5-N8, N20: lease / lowest-decile analyses -------------------------------

def lease_price_years(txn: DataFrame, years: Sequence[int]) -> DataFrame:
    """Year, month, year_count, price for the chosen years."""
    t = with_year_count(txn)
    y = year_of()
    return t.where(y.isin([int(v) for v in years])).select(
        y.alias("year"), "month", "year_count", "price")


def lease_budget_grid(txn: DataFrame, ages: Sequence[int], budgets: Sequence[float],
                      age_target: int = AGE_TARGET, digits: int = 2) -> DataFrame:
    """Per year and (age, budget): sales with lease >= age_target - age
    and price <= budget, out of all sales of the year.

    One aggregation pass with one conditional count per grid cell, then the
    cells are turned into rows.
    """
    t = with_year_count(txn)
    cells = [(int(a), float(b)) for a in ages for b in budgets]
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (a, b) in enumerate(cells):
        aggs.append(F.count_if((F.col("year_count") >= F.lit(age_target - a))
                               & (F.col("price") <= F.lit(b))).alias(f"c{i}"))
    per_year = t.groupBy(year_of().alias("year")).agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("age"), F.lit(b).alias("budget"),
                 F.lit(age_target - a).alias("min_lease"), F.col(f"c{i}").alias("matches"))
        for i, (a, b) in enumerate(cells)]))
    out = per_year.select("year", "total", rows.alias("c")).select(
        "year", "c.age", "c.budget", "c.min_lease", "c.matches", "total")
    return out.withColumn("pct", percent(F.col("matches"), F.col("total"), digits))


def lowest_decile_rows(trend: DataFrame, p: float = 0.1) -> DataFrame:
    """Rows at or below their month's p-quantile price.  The
    cutoffs (one per calendar month) are broadcast, so rows are not shuffled."""
    return boxstats.at_or_below_cutoff(trend, "price", ["month"], p, broadcast_cutoffs=True)


def lowest_decile_box(trend: DataFrame, p: float = 0.1, digits: int | None = None) -> DataFrame:
    """Box statistics by month of the rows at or below the cutoff."""
    rows = lowest_decile_rows(trend, p).select("month", "price")
    return boxstats.box_stats(rows, "price", ["month"], digits=digits)


def lease_box_by_town(txn: DataFrame, threshold: float = MILLION, digits: int | None = None) -> DataFrame:
    """Box statistics of remaining lease years by town, million-dollar sales."""
    t = with_year_count(txn).where(F.col("price") >= F.lit(threshold))
    return boxstats.box_stats(t, "year_count", ["town"], digits=digits)


def type_month_box(private: DataFrame, value: str = "nettPrice", digits: int | None = None) -> DataFrame:
    """Box statistics per (property_type, month)."""
    return boxstats.box_stats(private, value, ["property_type", "month"], digits=digits)


# -- N9-N15: attributes of expensive sales ------------------------------------

def lease_unit_corr(txn: DataFrame, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """corr(area, price), corr(lease, unit price) and the unit-price
    on lease regression line (one row)."""
    t = with_year_count(txn)
    if threshold is not None:
        t = t.where(F.col("price") >= F.lit(threshold))
    return t.agg(
        round_half_away(F.corr("area_sqft", "price"), digits).alias("corr_area_price"),
        round_half_away(F.corr("year_count", "price_sqft"), digits).alias("corr_lease_psf"),
        round_half_away(F.regr_slope("price_sqft", "year_count"), digits).alias("slope_psf_lease"),
        round_half_away(F.regr_intercept("price_sqft", "year_count"), digits).alias("intercept_psf_lease"),
    )


def unit_price_range(txn: DataFrame, threshold: float = MILLION, min_lease: int = 85,
                     digits: int = 2) -> DataFrame:
    """Unit-price range of million-dollar sales, all and for lease >= min_lease."""
    t = with_year_count(txn).where(F.col("price") >= F.lit(threshold))
    newer = F.col("year_count") >= F.lit(min_lease)
    psf = F.col("price_sqft")
    return t.agg(
        round_half_away(F.min(psf), digits).alias("psf_min"),
        round_half_away(F.max(psf), digits).alias("psf_max"),
        round_half_away(F.min(F.when(newer, psf)), digits).alias("psf_min_newer"),
        round_half_away(F.max(F.when(newer, psf)), digits).alias("psf_max_newer"),
    )


def storey_share(txn: DataFrame, threshold: float = MILLION, high_from: int = 10,
                 digits: int = 2) -> DataFrame:
    """Floor, storey_low, n, pct of million-dollar sales, high_floor
    (lowest storey >= ``high_from``)."""
    t = txn.where(F.col("price") >= F.lit(threshold))
    per = t.groupBy("floor").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    low = storey_low(F.col("floor"))
    return per.select("floor", low.alias("storey_low"), "n",
                      percent(F.col("n"), total, digits).alias("pct"),
                      F.coalesce(low >= F.lit(high_from), F.lit(False)).alias("high_floor"))


def high_storey_share(txn: DataFrame, threshold: float = MILLION, above: int = 10, digits: int = 2) -> DataFrame:
    """N11 as one figure: n million-dollar sales, n_high of them wholly above storey ``above``, and their pct."""
    t = txn.where(F.col("price") >= F.lit(threshold)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(storey_low(F.col("floor")) > F.lit(above), 1)).alias("n_high"))
    return t.select("n", "n_high", percent(F.col("n_high"), F.col("n"), digits).alias("pct"))


def min_area_million(txn: DataFrame, threshold: float = MILLION, digits: int = 2) -> DataFrame:
    """Smallest area (sqft) among million-dollar sales (one row)."""
    return txn.where(F.col("price") >= F.lit(threshold)).agg(round_half_away(F.min("area_sqft"), digits).alias("min_area_sqft"))


def top_sales(txn: DataFrame, threshold: float) -> DataFrame:
    """Every sale at or above ``threshold``, highest first (every column breaks ties)."""
    t = with_year_count(txn).where(F.col("price") >= F.lit(threshold))
    cols = ["price", "month", "town", "street", "flat", "floor", "lease", "year_count",
            "area_sqft", "price_sqft"]
    order = [F.col("price").desc()] + [F.col(c).asc_nulls_first() for c in cols[1:]]
    return t.select(*cols).orderBy(*order)


def price_extremes(txn: DataFrame, threshold: float) -> DataFrame:
    """Among sales >= threshold, the lowest unit price, largest area and
    least lease, each with its street (ties broken by street)."""
    t = with_year_count(txn).where(F.col("price") >= F.lit(threshold))
    lo_psf = F.min(F.struct("price_sqft", "street"))
    hi_area = F.max(F.struct("area_sqft", F.col("street")))
    lo_lease = F.min(F.struct("year_count", "street"))
    return t.agg(lo_psf.alias("a"), hi_area.alias("b"), lo_lease.alias("c"), F.count(F.lit(1)).alias("n")).select(
        "n",
        round_half_away("a.price_sqft", 2).alias("min_psf"), F.col("a.street").alias("min_psf_street"),
        round_half_away("b.area_sqft", 2).alias("max_area"), F.col("b.street").alias("max_area_street"),
        F.col("c.year_count").alias("min_lease"), F.col("c.street").alias("min_lease_street"),
    )


def same_street(txn: DataFrame, pattern: str) -> DataFrame:
    """Sales whose street text matches ``pattern`` (regex, upper-cased)."""
    return txn.where(F.col("street").rlike(pattern.upper()))


def residual_outliers(txn: DataFrame, x: str = "price_sqft", y: str = "price",
                      z_min: float = 3.0) -> DataFrame:
    """Rows far from the least-squares line of ``y`` on ``x``:
    residual = y - (intercept + slope*x), z = (residual - mean) / stddev;
    keeps |z| >= z_min.  Coefficients and residual moments are one-row
    aggregates attached by a broadcast hash join.
    """
    t = txn.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    coef = t.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    fitted = attach_scalars(t, coef).withColumn("_fit", F.col("_a") + F.col("_b") * F.col(x))
    res = fitted.withColumn("_res", F.col(y) - F.col("_fit"))
    moments = res.agg(F.avg("_res").alias("_m"), F.stddev_samp("_res").alias("_s"))
    z = F.try_divide(F.col("_res") - F.col("_m"), F.col("_s"))
    scored = attach_scalars(res, moments).withColumn("_z", z)
    return scored.where(F.abs("_z") >= F.lit(z_min)).select(
        "month", "town", "street", y, x,
        round_half_away("_fit", 2).alias("fitted"), round_half_away("_res", 2).alias("residual"),
        round_half_away("_z", 4).alias("z"))


# -- N19: bulk private sales ---------------------------------------------------

def bulk_sales(private: DataFrame) -> DataFrame:
    """is_bulk (more than one unit) and unit_price = nettPrice / noOfUnit."""
    return private.select(
        "*", (F.col("noOfUnit") > 1).alias("is_bulk"),
        F.try_divide(F.col("nettPrice"), F.col("noOfUnit").cast("double")).alias("unit_price"))


def drop_bulk(private: DataFrame) -> DataFrame:
    """Single-unit sales only."""
    return private.where(F.col("noOfUnit") <= 1)
