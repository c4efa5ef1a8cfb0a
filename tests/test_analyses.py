import pytest
from pyspark.sql import functions as F

from resalelens.operators import analyses as N
from resalelens.schemas import TREND


def trend_from_counts(spark, counts):
    """counts: {(month, town): (million, rest)} -> trend rows."""
    rows = []
    for (month, town), (mil, rest) in counts.items():
        rows += [(month, town, 1_200_000.0, 1, ">=1m")] * mil
        rows += [(month, town, 400_000.0, 1, "300-500k")] * rest
    return spark.createDataFrame(rows, TREND)


def test_percent_is_million_over_million_plus_rest(spark):
    # Published sample points: 2024-01 (74 million, 2547 others, 2.82 %),
    # 2024-06 (95, 2083, 4.36 %), 2024-07 (120, 2927, 3.94 %).
    t = trend_from_counts(spark, {("2024-01", "X"): (74, 2547), ("2024-06", "X"): (95, 2083),
                                  ("2024-07", "X"): (120, 2927)})
    got = {r.month: (r.million, r.rest, r.pct) for r in N.million_percent_rest(t).collect()}
    assert got == {"2024-01": (74, 2547, 2.82), "2024-06": (95, 2083, 4.36), "2024-07": (120, 2927, 3.94)}


def test_periods_share_the_split_month(spark):
    t = trend_from_counts(spark, {("2022-08", "X"): (3, 1), ("2022-09", "X"): (2, 1), ("2022-10", "X"): (5, 0)})
    got = sorted(map(tuple, N.monthly_million_periods(t, "2022-09").collect()))
    assert got == [("2022-08", "before", 3), ("2022-09", "after", 2), ("2022-09", "before", 2),
                   ("2022-10", "after", 5)]


@pytest.fixture()
def towns(spark):
    return trend_from_counts(spark, {
        ("2022-01", "BISHAN"): (3, 5), ("2023-02", "BISHAN"): (2, 1),
        ("2023-03", "YISHUN"): (1, 7), ("2024-01", "YISHUN"): (4, 0),
        ("2022-05", "QUEENSTOWN"): (0, 9),
    })


def test_crosstab_margins_add_up(towns):
    long = N.town_year_crosstab(towns)
    cells = {(r.town, r.year): r["count"] for r in long.collect()}
    assert cells[("All", "All")] == 10
    assert cells[("BISHAN", "All")] == 5 and cells[("All", "2023")] == 3
    inner = {k: v for k, v in cells.items() if "All" not in k}
    assert sum(inner.values()) == cells[("All", "All")]
    assert ("QUEENSTOWN", "All") not in cells  # empty cells stay empty
    totals = {r.town: r.town_total for r in long.collect()}
    assert totals["YISHUN"] == 5 and totals["All"] == 10
    wide = N.crosstab_wide(long, ["2022", "2023", "2024"]).collect()
    assert [r.town for r in wide] == ["All", "BISHAN", "YISHUN"]
    assert wide[1]["2024"] is None and wide[1]["All"] == 5


def test_year_change_first_year_and_records(towns):
    ch = {(r.town, r.year): (r["count"], r.prev_count, r.change) for r in N.town_year_change(towns).collect()}
    assert ch[("BISHAN", 2023)] == (2, 3, -1) and ch[("BISHAN", 2022)] == (3, None, None)
    first = {r.town: r.first_year for r in N.first_million_year(towns).collect()}
    assert first == {"BISHAN": 2022, "YISHUN": 2023}
    rec = {r.month: r.is_record for r in N.record_months(towns).collect()}
    assert rec["2022-01"] is True and rec["2022-05"] is False and rec["2024-01"] is True


def test_half_year_share(towns):
    got = {(r.year, r.half): (r["count"], r.million) for r in N.half_year_share(towns).collect()}
    assert got[(2022, "H1")] == (17, 3)


TXN_COLS = ["month", "town", "flat", "street", "floor", "lease", "area_sqm", "area_sqft",
            "price_sqm", "price_sqft", "price"]


@pytest.fixture()
def txn(spark):
    rows = [
        ("2024-01", "KALLANG", "EC", "BLK 1 A", "01-03", "47y", 366.0, 3947.0, 4098.0, 380.0, 1_500_000.0),
        ("2024-01", "BISHAN", "EC", "BLK 2 B", "13-15", "67y 02m", 172.0, 1851.0, 8721.0, 810.0, 1_500_000.0),
        ("2024-02", "BISHAN", "5RM", "BLK 3 C", "40-42", "90y", 110.0, 1184.0, 14545.0, 1351.0, 1_600_000.0),
        ("2024-02", "YISHUN", "4RM", "BLK 4 D", "04-06", "60y", 90.0, 969.0, 5000.0, 464.0, 450_000.0),
    ]
    return spark.createDataFrame(rows, TXN_COLS)


def test_extremes_of_expensive_sales(txn):
    r = N.price_extremes(txn, 1_500_000).first()
    assert (r.n, r.min_psf_street, r.max_area_street, r.min_lease, r.min_lease_street) == (
        3, "BLK 1 A", "BLK 1 A", 47, "BLK 1 A")
    top = N.top_sales(txn, 1_500_000).collect()
    assert len(top) == 3 and [t.street for t in top][:2] == ["BLK 3 C", "BLK 2 B"]  # ties broken by month, town


def test_storey_and_ranges(txn):
    st = {r.floor: (r.n, r.pct, r.high_floor) for r in N.storey_share(txn).collect()}
    assert st["13-15"] == (1, 33.33, True) and st["01-03"][2] is False
    rng = N.unit_price_range(txn).first()
    assert (rng.psf_min, rng.psf_max, rng.psf_min_newer) == (380.0, 1351.0, 1351.0)
    assert N.min_area_million(txn).first().min_area_sqft == 1184.0


def test_lease_budget_grid(txn):
    g = {(r.age, r.budget): (r.min_lease, r.matches, r.total) for r in
         N.lease_budget_grid(txn, [35, 40], [500_000]).collect()}
    assert g[(35, 500_000.0)] == (60, 1, 4) and g[(40, 500_000.0)] == (55, 1, 4)


def test_bulk_sales(spark):
    df = spark.createDataFrame([("2024-01", "T", 3_000_000.0, 3), ("2024-01", "T", 1_000_000.0, 1)],
                               "month string, property_type string, nettPrice double, noOfUnit int")
    got = [(r.is_bulk, r.unit_price) for r in N.bulk_sales(df).collect()]
    assert got == [(True, 1_000_000.0), (False, 1_000_000.0)]
    assert N.drop_bulk(df).count() == 1


def test_residual_outliers(spark):
    rows = [("2024-01", "T", f"BLK {i}", float(100 * i), float(i)) for i in range(1, 60)]
    rows.append(("2024-01", "T", "BLK X", 100000.0, 30.0))
    df = spark.createDataFrame(rows, "month string, town string, street string, price double, price_sqft double")
    out = N.residual_outliers(df).collect()
    assert [r.street for r in out] == ["BLK X"]
