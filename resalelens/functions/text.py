"""String column helpers (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_first(c: Column, literal: str, replacement: str) -> Column:
    """Replace the first occurrence of ``literal`` (plain text, not a regex).

    Spark's ``replace`` rewrites every match; the source rewrites only the
    first one.  The place is found and overlaid on the bytes of the text, with
    no regular expression.  ``c`` is referenced four times, so rules are chained
    as columns (``rewrite_column``), which the optimizer keeps apart.
    Null stays null; no match returns ``c``.
    """
    at = F.instr(c, literal)
    return F.when(at > 0, F.overlay(c, F.lit(replacement), at, F.lit(len(literal)))).otherwise(c)


def rewrite_first(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """``replace_first`` for each ``(literal, replacement)`` in order."""
    for literal, replacement in rules:
        c = replace_first(c, literal, replacement)
    return c


def rewrite_column(df: DataFrame, name: str, rules: Iterable[tuple[str, str]],
                   first_only: bool = True) -> DataFrame:
    """Rewrite column ``name`` with the rules in order (first match each, or
    every match with ``first_only=False``)."""
    if not first_only:
        return df.withColumn(name, rewrite_all(F.col(name), rules))
    for rule in rules:
        df = df.withColumn(name, rewrite_first(F.col(name), [rule]))
    return df


def rewrite_all(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Replace every occurrence for each rule (the ``strict=False`` lease option)."""
    for literal, replacement in rules:
        c = F.replace(c, F.lit(literal), F.lit(replacement))
    return c


def lease_years(lease: Column) -> Column:
    """Whole years of a rewritten lease text: ``"61y 04m"`` -> 61.

    Text before the first ``y``, cast leniently: a lease without a leading
    number gives null instead of failing the query.
    """
    return F.split(lease, "y").getItem(0).try_cast("int")


def storey_low(floor: Column) -> Column:
    """Lowest storey of a rewritten range: ``"10-12"`` -> 10."""
    return F.split(floor, "-").getItem(0).try_cast("int")


def unit_suffix(name: str) -> str:
    """``"area_sqft"`` -> ``"sqft"`` (parameter-side, no data pass)."""
    return name.split("_")[-1]


def split_names(text: str) -> list[str]:
    """Comma text -> trimmed names (parameter-side)."""
    return [part.strip() for part in text.split(",")]


def money(c: Column, digits: int = 2) -> Column:
    """``$1,234.50`` style text; null stays null."""
    return F.concat(F.lit("$"), F.format_number(c, digits))


def grouped_number(c: Column) -> Column:
    """A number rounded to two decimals as text: thousands separated by commas, and no
    more decimals than it has, but one at least (``1,234,567.5``, ``1,000,000.0``)."""
    return F.regexp_replace(F.format_number(c, 2), r"0$", "")
