"""Null-safe arithmetic helpers.

The session runs with ANSI mode on, where ``x / 0`` and bad casts raise.
Measures derived from user data go through ``try_divide`` / ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c: Column | str, digits: int = 0) -> Column:
    """Round a double to ``digits`` decimals the way the source
    application's frame library (and DuckDB) do: scale by ``10^d`` in
    floating point, round half away from zero, scale back.

    Spark's ``round`` instead rounds the exact decimal value of the double:
    ``43252.24 * 10 / 32`` is stored as 13516.32499.., so Spark gives 13516.32,
    while the scaled value 1351632.5 rounds to 13516.33 here.
    """
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    y = c.cast("double") * F.lit(m)
    half = (y - F.floor(y).cast("double")) == F.lit(0.5)
    r = F.when(half, y + F.signum(y) * F.lit(0.5)).otherwise(F.rint(y))
    return r / F.lit(m)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, null when ``den`` is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int | None = None) -> Column:
    """``100 * num / den``, optionally rounded (``round_half_away``)."""
    p = F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))
    return round_half_away(p, digits) if digits is not None else p


def to_double(c: Column) -> Column:
    """Lenient cast of text or number to double (non-numeric text -> null)."""
    return c.cast("string").try_cast("double")
