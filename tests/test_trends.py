import pytest
from pyspark.sql import functions as F

from resalelens.operators import clean, trends
from resalelens.schemas import RAW_TREND


@pytest.fixture()
def trend(spark):
    data = [
        ("2024-01", "A", "400000"), ("2024-01", "B", "1000000"), ("2024-01", None, "1200000"),
        ("2024-01", "C", "650000"),
        ("2024-02", "A", "250000"), ("2024-02", "B", "300000"), ("2024-02", "C", "310000"),
        ("2024-03", "A", "1500000"),  # only million sales
        (None, "A", "500000"),
    ]
    return clean.trend_frame(spark.createDataFrame(data, RAW_TREND))


def test_trend_frame(trend):
    r = trend.where("month = '2024-01' and town = 'A'").first()
    assert (r.price, r["count"], r.price_grp) == (400000.0, 1, "300-500k")


def test_median_even_and_odd(trend):
    got = {r.month: r.median_price for r in trends.median_by_month(trend).collect()}
    assert got["2024-01"] == (650000 + 1000000) / 2
    assert got["2024-02"] == 300000.0
    marks = {r.month: r.price_bar for r in trends.median_marks(trend).collect()}
    assert marks["2024-01"] == 1 and marks["2024-02"] == 0
    assert {r.month for r in trends.high_median_months(trend).collect()} == {"2024-01", "2024-03", None}


def test_million_table_counts_non_null_towns(trend):
    got = {r["month"]: tuple(r) for r in trends.million_table(trend).collect()}
    assert got["2024-01"] == ("2024-01", 2, 1, 3, 33.33)  # null town not counted
    assert got["2024-02"] == ("2024-02", 3, 0, 3, 0.0)
    assert got["2024-03"] == ("2024-03", 0, 1, 1, 100.0)


def test_group_share_sums_to_100_and_matches_join(trend):
    a = trends.group_share(trend)
    b = trends.group_share_join(trend)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    for r in a.groupBy("month").agg(F.sum("pct").alias("s")).collect():
        assert abs(r.s - 100) <= 0.1 * 5
    assert a.where(F.col("month").isNull()).count() == 0


def test_million_share_from_month(trend):
    got = trends.million_share(trend, from_month="2024-02").collect()
    assert sorted(r.month for r in got) == ["2024-02", "2024-03"]


def test_counts_below_from(trend):
    got = {r.month: (r.below, r.at_or_above) for r in trends.counts_below_from(trend).collect()}
    assert got["2024-01"] == (1, 3)
