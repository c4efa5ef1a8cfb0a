"""Value binning into labelled, left-closed intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from resalelens.schemas import PRICE_BREAKS, PRICE_LABELS


def _check(breaks: Sequence[float], labels: Sequence[str]) -> None:
    if len(labels) != len(breaks) + 1:
        raise ValueError(f"{len(breaks)} breaks need {len(breaks) + 1} labels, got {len(labels)}")
    if list(breaks) != sorted(breaks):
        raise ValueError("breaks must be ascending")


def bin_ordinal(c: Column, breaks: Sequence[float] = PRICE_BREAKS) -> Column:
    """Index of the interval ``[b[i-1], b[i])`` holding ``c`` (0..len(breaks)); null stays null."""
    expr = F.lit(len(breaks))
    for i in reversed(range(len(breaks))):
        expr = F.when(c < F.lit(breaks[i]), F.lit(i)).otherwise(expr)
    return F.when(c.isNotNull(), expr)


def bin_label(c: Column, breaks: Sequence[float] = PRICE_BREAKS,
              labels: Sequence[str] = PRICE_LABELS) -> Column:
    """Label of the left-closed interval holding ``c``; null stays null."""
    _check(breaks, labels)
    expr = F.lit(labels[-1])
    for i in reversed(range(len(breaks))):
        expr = F.when(c < F.lit(breaks[i]), F.lit(labels[i])).otherwise(expr)
    return F.when(c.isNotNull(), expr)


def bin_bounds(breaks: Sequence[float] = PRICE_BREAKS, labels: Sequence[str] = PRICE_LABELS):
    """``[(ordinal, label, lower, upper)]`` with ``None`` for open ends (parameter-side)."""
    _check(breaks, labels)
    lows = [None, *breaks]
    highs = [*breaks, None]
    return [(i, labels[i], lows[i], highs[i]) for i in range(len(labels))]
