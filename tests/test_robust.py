import numpy as np
import pytest

from conftest import rows
from resalelens.operators import analyses, robust


def plain_line(x, y):
    """The same fit in numpy: resistant start, fixed scale, bisquare rounds."""
    lo, hi = np.quantile(x, [1 / 3, 2 / 3])
    left, right = x <= lo, x >= hi
    dx = np.median(x[right]) - np.median(x[left])
    b = (np.median(y[right]) - np.median(y[left])) / dx if dx > 0 else 0.0
    a = np.median(y - b * x)
    scale = robust.MEDIAN_TO_SCALE * np.median(np.abs(y - a - b * x))
    for _ in range(robust.ROUNDS):
        u = (y - a - b * x) / (robust.CUT * scale)
        w = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)
        b, a = np.polyfit(x, y, 1, w=np.sqrt(w))
    return a, b, robust.MEDIAN_TO_SCALE * np.median(np.abs(y - a - b * x))


@pytest.fixture(scope="module")
def planted():
    """2000 rows about a line; one row in twenty is a cheap sale among the dearest unit prices."""
    r = np.random.default_rng(5)
    x = r.uniform(300, 1000, 2000)
    y = 1000 * x + r.normal(0, 20000, 2000)
    bad = np.arange(2000) % 20 == 0
    x[bad] = r.uniform(1900, 2000, bad.sum())
    y[bad] = 2e5 + r.normal(0, 20000, bad.sum())
    return x, y, bad


def frame(spark, x, y):
    return spark.createDataFrame([(i, "2024-01", "T", "S", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 "i int, month string, town string, street string, price_sqft double, price double")


def test_line_equals_plain_fit(spark, planted):
    x, y, _ = planted
    line = robust.robust_line(frame(spark, x, y), "price_sqft", "price")
    a, b, scale = plain_line(x, y)
    assert line.converged and line.rounds <= robust.ROUNDS
    assert line.slope == pytest.approx(b, rel=1e-6) and line.intercept == pytest.approx(a, rel=1e-4, abs=1)
    assert line.scale == pytest.approx(scale, rel=1e-6)
    assert line.slope == pytest.approx(1000, rel=0.01)


def test_planted_outliers_are_found_where_least_squares_misses_them(spark, planted):
    x, y, bad = planted
    df = frame(spark, x, y)
    found = {r["i"] for r in robust.robust_outliers(df, z_min=4.0).collect()}
    assert set(np.flatnonzero(bad)) <= found and len(found) <= bad.sum() + 3
    # The least-squares line is drawn to the planted rows: it misses nearly all of them.
    seen = {round(r["price"], 6) for r in analyses.residual_outliers(df, z_min=4.0).collect()}
    assert len(seen & {round(v, 6) for v in y[bad]}) < bad.sum() / 2


def test_rounds_are_bounded(spark, planted):
    x, y, _ = planted
    line = robust.robust_line(frame(spark, x, y), "price_sqft", "price", rounds=2)
    assert line.rounds == 2 and not line.converged


def test_exact_line_nulls_repeats_and_constants(spark):
    pts = [(float(i), 2.0 * i + 1) for i in range(9)] + [(4.0, 100.0), (4.0, 100.0), (None, 5.0), (5.0, None),
                                                          (float("nan"), 1.0), (float("inf"), 1.0)]
    df = spark.createDataFrame(pts, "price_sqft double, price double")
    line = robust.robust_line(df, "price_sqft", "price")
    assert (line.slope, line.intercept, line.scale) == (2.0, 1.0, 0.0)
    assert rows(robust.robust_outliers(df), "price", "fitted", "z") == [(100.0, 9.0, float("inf"))] * 2
    flat = spark.createDataFrame([(3.0, float(v)) for v in (1, 2, 3, 4, 90)], "price_sqft double, price double")
    assert robust.robust_line(flat, "price_sqft", "price").slope == 0.0
    assert [p for (p,) in rows(robust.robust_outliers(flat), "price")] == [90.0]


def test_empty(spark):
    df = spark.createDataFrame([], "price_sqft double, price double")
    assert robust.robust_line(df, "price_sqft", "price") is None
    assert rows(robust.robust_outliers(df)) == []
