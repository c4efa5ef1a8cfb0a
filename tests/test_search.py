import pytest
from pyspark.sql import functions as F

from resalelens.operators import search as S
from resalelens.schemas import TXN

ROWS = [
    # month, town, flat, street, floor, lease, area_sqm, area_sqft, price_sqm, price_sqft, price
    ("2024-01", "BISHAN", "3RM", "BLK 1 BISHAN ST 11", "10-12", "61y 04ms", 70.0, 70 * 10.7639, 5000.0, 5000 / 10.7639, 350000.0),
    ("2024-01", "BISHAN", "4RM", "BLK 2 BISHAN ST 12", "01-03", "95y", 100.0, 100 * 10.7639, 9000.0, 9000 / 10.7639, 900000.0),
    ("2024-02", "YISHUN", "3RM", "BLK 3 YISHUN RING", "04-06", "55y 01m", 65.0, 65 * 10.7639, 4000.0, 4000 / 10.7639, 260000.0),
    ("2024-02", "YISHUN", "EC", "BLK 4 MAMOR LANE", "13-15", None, 130.0, 130 * 10.7639, None, None, None),
    ("2024-03", "BISHAN", "MG", "BLK 5 BISHAN ST 13", "07-09", "abc", 160.0, 160 * 10.7639, 7000.0, 7000 / 10.7639, 1120000.0),
]


@pytest.fixture()
def txn(spark):
    return spark.createDataFrame(ROWS, TXN)


def test_no_criteria_selects_everything(txn):
    s = S.search(txn, S.SearchParams())
    assert S.flag_names(s) == []
    assert S.selected(s).count() == 5 and S.rest_set(s).count() == 0 and S.rest_bag(s).count() == 0


def test_zero_and_empty_bounds_add_no_flag(txn):
    s = S.search(txn, S.SearchParams(max_price=0, min_area=None, street="", min_lease=0))
    assert S.flag_names(s) == []


def test_empty_flat_list_matches_nothing(txn):
    s = S.search(txn, S.SearchParams(flats=[]))
    assert S.selected(s).count() == 0 and S.rest_set(s).count() == 5


def test_flags_are_null_safe_and_use_unrounded_values(txn):
    p = S.SearchParams(town="BISHAN", min_lease=60, max_price=900000, flats=["3RM", "4RM", "MG"])
    s = S.search(txn, p)
    flags = {r.street: (r.min_lease_flag, r.town_flag, r.max_price_flag, r.flat_flag) for r in s.collect()}
    assert flags["BLK 1 BISHAN ST 11"] == (True, True, True, True)
    assert flags["BLK 2 BISHAN ST 12"] == (True, True, True, True)  # price bound is inclusive
    assert flags["BLK 4 MAMOR LANE"] == (False, False, False, False)  # null lease/price -> False
    assert flags["BLK 5 BISHAN ST 13"][0] is False  # lease text without a number
    assert [r.street for r in S.selected(s).collect()] == ["BLK 1 BISHAN ST 11", "BLK 2 BISHAN ST 12"]


def test_lease_bounds_named_by_meaning(txn):
    s = S.search(txn, S.SearchParams(min_lease=60, max_lease=90))
    got = {r.lease: (r.min_lease_flag, r.max_lease_flag) for r in s.collect()}
    assert got["61y 04ms"] == (True, True)
    assert got["95y"] == (True, False)
    assert got["55y 01m"] == (False, True)


def test_street_pattern_is_regex_upper_cased(txn):
    s = S.search(txn, S.SearchParams(street="bishan st 1[12]|mamor"))
    got = sorted(r.street for r in S.selected(s).collect())
    assert got == ["BLK 1 BISHAN ST 11", "BLK 2 BISHAN ST 12", "BLK 4 MAMOR LANE"]
    with pytest.raises(ValueError):
        S.search(txn, S.SearchParams(street="("))


def test_unit_dependent_projection_and_measure(txn):
    p = S.SearchParams(area_type="area_sqm", price_type="price_area", min_price=4500)
    s = S.search(txn, p)
    assert "area_sqft" not in s.columns and "price_sqft" not in s.columns
    assert p.measure() == "price_sqm"
    assert sorted(r.price for r in S.selected(s).collect()) == [350000.0, 900000.0, 1120000.0]
    r = s.where(F.col("street") == "BLK 1 BISHAN ST 11").first()
    assert r.area_sqm == 70.0 and r.year_count == 61


def test_selected_and_rest_partition_the_rows(txn):
    p = S.SearchParams(town="BISHAN", min_lease=60, flats=["3RM", "MG"], max_price=1000000)
    s = S.search(txn, p)
    sel = S.selected(s).collect()
    rest = S.rest_set(s).collect()
    assert len(sel) + len(rest) == 5
    assert not {r.street for r in sel} & {r.street for r in rest}
    # the bag has one row per failed flag
    n_fail = sum(sum(not r[f] for f in S.flag_names(s)) for r in s.collect())
    bag = S.rest_bag(s)
    assert bag.count() == n_fail
    assert set(bag.columns) == set(S.selected(s).columns) | {"failed_flag"}
    sc = S.scatter_price_unit(s, p)
    assert sc.where("series = 'selected'").count() == len(sel)
    assert sc.where("series = 'rest'").count() == n_fail


def test_summary_and_text(txn):
    p = S.SearchParams(town="BISHAN", min_lease=60, max_lease=99)
    s = S.search(txn, p)
    r = S.summary(s, p).first()
    assert (r.records, r.price_min, r.price_max) == (2, 350000.0, 900000.0)
    t = S.summary_text(s, p).first().text
    assert t.startswith("You searched : Town: BISHAN | price: $350,000.0 - $900,000.0 | area_sqft: ")
    assert t.endswith("| Lease from 60 - 99 | Total records: 2")
    none = S.SearchParams(town="NOWHERE")
    r = S.summary_text(S.search(txn, none), none).first()
    assert (r.records, r.text) == (0, S.NO_RESULTS)
    assert S.summary(S.search(txn, none), none).first().price_min is None


def test_page_is_stable_and_offset(txn):
    ordered = [r.price for r in S.page(txn, "price", ascending=False, offset=0, size=5).collect()]
    assert ordered == [1120000.0, 900000.0, 350000.0, 260000.0, None]
    assert [r.price for r in S.page(txn, "price", ascending=False, offset=1, size=2).collect()] == [900000.0, 350000.0]


def test_global_min_max(txn):
    r = S.global_min_max(txn).first()
    assert (r.price_min, r.price_max) == (260000.0, 1120000.0)


def test_months_filter(txn):
    s = S.search(txn, S.SearchParams(months=["2024-02"]))
    assert s.count() == 2


def test_select_rows_equals_flag_route(txn):
    for p in [S.SearchParams(town="BISHAN", min_lease=60, max_price=900000, flats=["3RM", "4RM", "MG"]),
              S.SearchParams(area_type="area_sqm", price_type="price_area", min_price=4500),
              S.SearchParams(flats=[]), S.SearchParams()]:
        a = sorted(map(repr, S.selected(S.search(txn, p)).collect()))
        b = sorted(map(repr, S.select_rows(txn, p).collect()))
        assert a == b
        assert S.select_rows(txn, p).columns == S.selected(S.search(txn, p)).columns
