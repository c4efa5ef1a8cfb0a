"""Flagged transaction search.

``search`` keeps every row and adds one boolean ``*_flag`` column per active
criterion, all in one projection (no shuffle).  ``selected``, ``rest_set``,
``rest_bag`` and the scatter/summary operators derive from it; Catalyst
collapses the projections and pushes the month filter into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resalelens.functions.numeric import round_half_away
from resalelens.functions.text import grouped_number, lease_years, unit_suffix
from resalelens.operators.paging import sorted_page
from resalelens.schemas import ALL_TOWNS

AREA_TYPES = ("area_sqft", "area_sqm")
PRICE_TYPES = ("price", "price_area")


def resolve_measure(price_type: str, area_type: str) -> str:
    """``price`` stays; anything else is the unit price of ``area_type``."""
    if area_type not in AREA_TYPES:
        raise ValueError(f"area_type must be one of {AREA_TYPES}")
    if price_type == "price":
        return "price"
    return "price_" + unit_suffix(area_type)


@dataclass(frozen=True)
class SearchParams:
    """Search criteria.  A bound that is None, 0 or "" adds no flag (F8).

    ``flats=None`` adds no flat criterion; an empty list matches nothing.
    ``months`` keeps only those months (a row filter, pruned at the scan).
    ``street`` is a regular expression matched against the upper-cased
    ``BLK <block> <street>`` text; ``|`` separates alternatives.
    """
    town: str = ALL_TOWNS
    flats: Sequence[str] | None = None
    area_type: str = "area_sqft"
    max_area: float | None = None
    min_area: float | None = None
    price_type: str = "price"
    max_price: float | None = None
    min_price: float | None = None
    min_lease: int | None = None
    max_lease: int | None = None
    street: str | None = None
    months: Sequence[str] | None = None

    def measure(self) -> str:
        return resolve_measure(self.price_type, self.area_type)


def flag_predicates(p: SearchParams) -> list[tuple[str, Column]]:
    """``(flag name, predicate)`` for each active criterion (F2-F8), in a
    fixed order.  Predicates may be null (missing values)."""
    preds: list[tuple[str, Column]] = []
    yc = F.col("year_count")
    if p.min_lease:
        preds.append(("min_lease_flag", yc >= F.lit(int(p.min_lease))))
    if p.max_lease:
        preds.append(("max_lease_flag", yc <= F.lit(int(p.max_lease))))
    if p.flats is not None:
        flats = list(p.flats)
        preds.append(("flat_flag", F.col("flat").isin(flats) if flats else F.lit(False)))
    if p.street:
        pattern = p.street.upper()
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid street pattern {p.street!r}: {e}") from None
        preds.append(("street_flag", F.col("street").rlike(pattern)))
    if p.town != ALL_TOWNS:
        preds.append(("town_flag", F.col("town") == F.lit(p.town)))
    measure = p.measure()
    if p.max_price:
        preds.append(("max_price_flag", F.col(measure) <= F.lit(float(p.max_price))))
    if p.min_price:
        preds.append(("min_price_flag", F.col(measure) >= F.lit(float(p.min_price))))
    if p.max_area:
        preds.append(("max_area_flag", F.col(p.area_type) <= F.lit(float(p.max_area))))
    if p.min_area:
        preds.append(("min_area_flag", F.col(p.area_type) >= F.lit(float(p.min_area))))
    return preds


def flag_columns(p: SearchParams) -> list[Column]:
    """The active ``*_flag`` columns; D4: a null predicate is "not matched"."""
    return [F.coalesce(pred, F.lit(False)).alias(name) for name, pred in flag_predicates(p)]


def flag_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_flag")]


def search(txn: DataFrame, p: SearchParams) -> DataFrame:
    """every row of ``txn`` (optionally only ``p.months``) with
    ``year_count`` and the flags; price, unit price and area of the chosen
    unit rounded to 2, the other unit's columns dropped (P10).

    Flags test the unrounded values.
    """
    df = _with_year_count(txn, p)
    return df.select(*_output_columns(df, p), *flag_columns(p))


def _with_year_count(txn: DataFrame, p: SearchParams) -> DataFrame:
    df = txn
    if p.months is not None:
        df = df.where(F.col("month").isin(list(p.months)))
    return df.withColumn("year_count", lease_years(F.col("lease")))


def _output_columns(df: DataFrame, p: SearchParams) -> list[Column]:
    unit = unit_suffix(p.area_type)
    other = "sqm" if unit == "sqft" else "sqft"
    keep = [c for c in df.columns if c not in (f"area_{other}", f"price_{other}")]
    rounded = {"price", f"price_{unit}", f"area_{unit}"}
    return [round_half_away(F.col(c), 2).alias(c) if c in rounded else F.col(c) for c in keep]


def select_rows(txn: DataFrame, p: SearchParams) -> DataFrame:
    """F10 without flag columns: the rows passing every criterion, filtered
    on the predicates themselves (a WHERE already treats null as "not
    matched").  Plain bounds such as ``price <= x`` or ``flat IN (..)``
    reach the parquet scan as PushedFilters and ``months`` as partition
    filters.  Same rows and columns as ``selected(search(txn, p))``."""
    df = _with_year_count(txn, p)
    preds = [pred for _, pred in flag_predicates(p)]
    if preds:
        df = df.where(reduce(lambda a, b: a & b, preds))
    return df.select(*_output_columns(df, p))


def all_flags(df: DataFrame) -> Column:
    flags = flag_names(df)
    return reduce(lambda a, b: a & b, [F.col(f) for f in flags]) if flags else F.lit(True)


def selected(searched: DataFrame) -> DataFrame:
    """rows passing every flag, flags dropped."""
    return searched.where(all_flags(searched)).drop(*flag_names(searched))


def rest_set(searched: DataFrame) -> DataFrame:
    """rows failing at least one flag, once each, flags dropped."""
    return searched.where(~all_flags(searched)).drop(*flag_names(searched))


def _failed_array(flags: list[str]) -> Column:
    arr = F.array(*[F.when(~F.col(f), F.lit(f)) for f in flags])
    return F.filter(arr, lambda x: x.isNotNull())


def rest_bag(searched: DataFrame) -> DataFrame:
    """a row once per failed flag (the source's union of per-flag
    complements), with the ``failed_flag`` name; one pass via ``explode``
    instead of one scan per flag."""
    flags = flag_names(searched)
    if not flags:
        return searched.limit(0).withColumn("failed_flag", F.lit(None).cast("string"))
    base = [c for c in searched.columns if c not in flags]
    return searched.select(*base, F.explode(_failed_array(flags)).alias("failed_flag"))


def _series_rows(searched: DataFrame, cols: list[Column]) -> DataFrame:
    """Selected rows once as ``selected``, other rows once per failed flag as
    ``rest`` -- both chart series from a single pass."""
    flags = flag_names(searched)
    if flags:
        failed = _failed_array(flags)
        tags = F.when(F.size(failed) == 0, F.array(F.lit("selected"))).otherwise(
            F.transform(failed, lambda _: F.lit("rest")))
    else:
        tags = F.array(F.lit("selected"))
    return searched.select(F.explode(tags).alias("series"), *cols)


def scatter_price_unit(searched: DataFrame, p: SearchParams) -> DataFrame:
    """Price vs unit price with hover fields (series, price, unit price,
    year_count, town, street, area)."""
    unit_price = "price_" + unit_suffix(p.area_type)
    cols = [F.col("price"), F.col(unit_price), F.col("year_count"), F.col("town"),
            F.col("street"), F.col(p.area_type)]
    return _series_rows(searched, cols)


def scatter_price_lease(searched: DataFrame, p: SearchParams) -> DataFrame:
    """Chosen measure vs remaining lease years, with hover fields."""
    measure = p.measure()
    unit_price = "price_" + unit_suffix(p.area_type)
    cols = [F.col(measure).alias("measure"), F.col("year_count"), F.col("price"),
            F.col(unit_price).alias("unit_price"), F.col("town"), F.col("street"),
            F.col(p.area_type).alias("area")]
    return _series_rows(searched, cols)


def global_min_max(txn: DataFrame) -> DataFrame:
    """min/max of price and area_sqft (one row)."""
    return txn.agg(
        F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        F.min("area_sqft").alias("area_min"), F.max("area_sqft").alias("area_max"),
    )


def summary(searched: DataFrame, p: SearchParams) -> DataFrame:
    """Records, min/max of the chosen area and measure over the
    selected rows (one row; min/max null when nothing is selected).
    ``searched`` is ``search(...)`` output or already selected rows."""
    measure = p.measure()
    sel = selected(searched) if flag_names(searched) else searched
    return sel.agg(
        F.count(F.lit(1)).alias("records"),
        F.min(measure).alias("price_min"), F.max(measure).alias("price_max"),
        F.min(p.area_type).alias("area_min"), F.max(p.area_type).alias("area_max"),
    )


NO_RESULTS = "<< YOUR SEARCH HAS NO RESULTS >>"


def summary_text(searched: DataFrame, p: SearchParams) -> DataFrame:
    """One-line description of the search, or the no-results text."""
    s = summary(searched, p)
    price_label = "price" if p.price_type == "price" else f"Price / {unit_suffix(p.area_type)}"
    parts = [
        F.lit(f"You searched : Town: {p.town} | {price_label}: $"),
        grouped_number(F.col("price_min")), F.lit(" - $"), grouped_number(F.col("price_max")),
        F.lit(f" | {p.area_type}: "),
        grouped_number(F.col("area_min")), F.lit(" - "), grouped_number(F.col("area_max")),
    ]
    if p.min_lease and p.max_lease:
        parts.append(F.lit(f" | Lease from {int(p.min_lease):,} - {int(p.max_lease):,}"))
    elif p.min_lease:
        parts.append(F.lit(f" | Lease >= {int(p.min_lease):,}"))
    elif p.max_lease:
        parts.append(F.lit(f" | Lease =< {int(p.max_lease):,}"))
    parts += [F.lit(" | Total records: "), F.format_number("records", 0)]
    text = F.when(F.col("records") > 0, F.concat(*parts)).otherwise(F.lit(NO_RESULTS))
    return s.select("records", text.alias("text"))


def page(df: DataFrame, sort_col: str, ascending: bool = True, offset: int = 0,
         size: int = 20) -> DataFrame:
    """O3: one page of a result table sorted by ``sort_col``; every other
    column breaks ties so pages are stable.  The first pages are a
    per-partition top-(offset+size); deep ones go through a rank index
    (``operators.paging``) and sort about one bracket of the rows."""
    return sorted_page(df, [(sort_col, ascending), *[(c, True) for c in df.columns if c != sort_col]], offset, size)
