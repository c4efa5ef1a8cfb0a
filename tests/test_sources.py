import json
import os

import pytest
from pyspark.sql import functions as F

from resalelens.schemas import RAW_TXN, RAW_FIELDS
from resalelens.session import scratch_path
from resalelens.sources import envelope, history, month_source, months


def rec(month, price="500000"):
    return {"month": month, "block": "1", "town": "T", "flat_type": "3 ROOM", "street_name": "S",
            "storey_range": "01 TO 03", "floor_area_sqm": "60", "remaining_lease": "90 years",
            "resale_price": price}


@pytest.fixture()
def env_dir(spark):
    path = scratch_path(spark, "env-test")
    for month, recs in [("2024-01", [rec("2024-01"), rec("2024-01", "600000")]),
                        ("2024-02", [rec("2024-02")]), ("2024-03", [])]:
        d = os.path.join(path, f"month={month}")
        os.makedirs(d)
        with open(os.path.join(d, "part-0.json"), "w") as fh:
            fh.write(json.dumps({"result": {"records": recs}}) + "\n")
            fh.write(json.dumps({"result": {}}) + "\n")  # envelope without records
    return path


def test_envelope_scan(spark, env_dir):
    df = envelope.read_envelopes(spark, env_dir)
    assert df.columns == RAW_FIELDS and df.count() == 3


def test_envelope_write_read_roundtrip(spark):
    data = [tuple(rec(m).values()) for m in ["2024-01", "2024-01", "2024-02"]]
    src = spark.createDataFrame(data, RAW_TXN)
    path = scratch_path(spark, "env-rt")
    envelope.write_envelopes(src, path, page_size=1)
    back = envelope.read_envelopes(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, src.collect()))


def test_month_source_partitions_pushdown_and_limit(spark, env_dir):
    pages = month_source.StoredPages(spark, env_dir)
    df = month_source.read_month_source(spark, pages, pages.months())
    assert pages.months() == ["2024-01", "2024-02", "2024-03"] and df.count() == 3
    assert df.rdd.getNumPartitions() == 3  # one request a month
    pruned = df.where(F.col("month") == "2024-02")
    assert pruned.count() == 1
    assert month_source.read_month_source(spark, pages, ["2024-01"], limit=1).count() == 1
    sub = month_source.read_month_source(spark, pages, pages.months(), fields=["month", "resale_price"])
    assert sub.columns == ["month", "resale_price"]
    assert month_source.read_month_source(spark, pages, ["1999-01"]).count() == 0
    assert month_source.read_month_source(spark, pages, []).count() == 0


def _all(spark, path, **kw):
    pages = month_source.StoredPages(spark, str(path))
    return month_source.read_month_source(spark, pages, kw.pop("months", pages.months()), **kw)


def test_month_source_error_modes(spark, tmp_path):
    d = tmp_path / "month=2024-01"
    d.mkdir()
    (d / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception):
        _all(spark, tmp_path).count()
    assert _all(spark, tmp_path, on_error="skip").count() == 0
    with pytest.raises(ValueError):
        _all(spark, tmp_path, on_error="ignore")


def test_union_history_recent_keeps_overlap(spark):
    hist = spark.createDataFrame([("2024-01", "A", 1.0, "id1"), ("2024-02", "A", 2.0, "id2")],
                                 "month string, town string, resale_price double, _id string").drop("_id")
    recent = spark.createDataFrame([("2024-02", "A", "2"), ("2024-03", "A", "x")],
                                   "month string, town string, resale_price string")
    u = history.union_history_recent(hist, recent)
    assert u.count() == 4
    assert dict(u.dtypes)["resale_price"] == "double"
    assert u.where("resale_price is null").count() == 1
    assert history.union_history_recent(hist, recent, recent_from="2024-02").count() == 3


def test_projection_spec(spark):
    df = spark.createDataFrame([(1, '{"k": 1, "n": null}'), (2, '{"j": 2}'), (3, None)], "id long, props string")
    out = history.json_fields_exist(df, "props", "k, n", keep=["id"]).collect()
    assert [(r.id, r.k, r.n) for r in out] == [(1, "1", None)]
    assert history.projection_spec(" a, b ,c") == ["a", "b", "c"]
    assert history.projection_spec(df) == ["id", "props"]
    with pytest.raises(ValueError):
        history.select_spec(df, "id, missing")


def test_month_generators(spark):
    b = spark.createDataFrame([("2023-11-15", "2024-02-01")], "start string, end string")
    assert [r.month for r in months.month_range(b).collect()] == ["2023-11", "2023-12", "2024-01", "2024-02"]
    a = spark.createDataFrame([("2024-08-10",), ("2024-08-11",)], "as_of string")
    got = [r.month for r in months.recent_months(a).collect()]
    assert got[:7] == ["2024-02", "2024-03", "2024-04", "2024-05", "2024-06", "2024-07", "2024-08"]
    assert got[7:] == ["2024-03", "2024-04", "2024-05", "2024-06", "2024-07", "2024-08"]


def test_typed_empty_frame(spark):
    e = history.empty_frame(spark, RAW_TXN)
    assert e.count() == 0 and e.schema == RAW_TXN


def test_records_json(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert envelope.records_json(df).first().record == '{"x":1,"y":"a"}'


def test_month_source_fetch_gets_month_fields_and_header(spark):
    def fetch(month, fields, header):
        yield {"month": month, "town": header["x-api-key"], "resale_price": len(fields), "more": "dropped"}
        yield {"month": month, "resale_price": 500000.5}

    rows = month_source.read_month_source(spark, fetch, ["2024-01", "2024-02", "2024-01"], header={"x-api-key": "k1"},
                                          fields=["month", "town", "resale_price"])
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(
        [(m, *r) for m in ("2024-01", "2024-02") for r in (("k1", "3"), (None, "500000.5"))], key=repr)
    refused = month_source.read_month_source(spark, fetch, ["2024-01"])
    with pytest.raises(Exception):
        refused.count()


def test_month_source_filters_prune_requests_only_where_enabled(spark):
    def fetch(month, fields, header):
        if month == "2024-09":
            raise ConnectionError("asked for a month that is not needed")
        yield {"month": month}

    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
            df = month_source.read_month_source(spark, fetch, ["2024-01", "2024-09"], fields=["month"]).where("month = '2024-01'")
            if on == "true":
                assert df.count() == 1
                assert df.where("month = '2023-01'").count() == 0
            else:
                with pytest.raises(Exception):
                    df.count()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def _page(folder, month, records, name="p.json"):
    import json
    d = folder / f"month={month}"
    d.mkdir(exist_ok=True)
    (d / name).write_text(json.dumps({"result": {"records": records}}))


def test_month_source_large_pages_bad_months_and_null_months(spark, tmp_path):
    big = [{"month": "2024-01", "town": "T" * 200, "resale_price": str(i)} for i in range(10_000)]
    _page(tmp_path, "2024-01", big)
    _page(tmp_path, "2024-02", [{"month": None, "town": "A"}, {"month": "2024-02", "town": "B"}])
    df = _all(spark, tmp_path)
    assert df.count() == 10_002  # a page larger than one reader block
    assert df.where(df.month.isin("2024-01", "2024-02")).count() == 10_001  # null months are not "in"
    (tmp_path / "month=2024-03").mkdir()
    (tmp_path / "month=2024-03" / "p.json").write_text("{broken")
    _page(tmp_path, "2024-04", [{"month": "2020-01", "town": "lost"}])
    _page(tmp_path, "2024-05", [{"month": "2024-05", "town": "C"}])
    assert _all(spark, tmp_path, on_error="skip").count() == 10_003
    with pytest.raises(Exception, match="another month"):
        _all(spark, tmp_path, months=["2024-04"]).count()


def test_month_source_skip_leaves_out_failed_requests_only(spark):
    def read(error, months=("2024-01", "2024-02")):
        def fetch(month, fields, header):
            yield {"month": month}
            if month == "2024-02":
                raise error
        return month_source.read_month_source(spark, fetch, months, fields=["month"], on_error="skip")

    for error in (ConnectionError("gone"), TimeoutError("late"), PermissionError("no"), month_source.FetchError("declared")):
        assert [r.month for r in read(error).collect()] == ["2024-01"]
    for error in (MemoryError("worker memory"), KeyError("fault in fetch"), ValueError("fault in fetch")):
        with pytest.raises(Exception, match=type(error).__name__):
            read(error).collect()


def test_month_source_skip_holds_a_month_on_disk():
    import base64

    import pyarrow as pa
    from pyspark import cloudpickle
    from pyspark.sql import types as T

    n = 40 * month_source.BATCH

    def fetch(month, fields, header):
        for i in range(n):
            yield {"month": month, "town": f"{i:0100d}"}

    schema = T.StructType([T.StructField("month", T.StringType()), T.StructField("town", T.StringType())])
    reader = month_source._Reader(schema, {"months": '["2024-01"]', "on_error": "skip",
                                           "fetch": base64.b64encode(cloudpickle.dumps(fetch)).decode()})
    part, = reader.partitions()
    rows = most = 0
    for batch in reader.read(part):
        rows += batch.num_rows
        del batch
        most = max(most, pa.total_allocated_bytes())
    assert rows == n and most < n * 100 / 4  # a few batches, not the month


def test_stored_pages_split_a_month_by_file(spark, tmp_path):
    for k in range(3):
        _page(tmp_path, "2024-01", [{"month": "2024-01", "town": f"{k}{i}"} for i in range(2)], f"p{k}.json")
    _page(tmp_path, "2024-02", [{"month": "2024-02", "town": "x"}])
    df = _all(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.town for r in df.collect()) == ["00", "01", "10", "11", "20", "21", "x"]
    # A limit and a skipped month are about the whole month.
    assert _all(spark, tmp_path, limit=1).count() == 2
    (tmp_path / "month=2024-01" / "p9.json").write_text("{broken")
    assert [r.town for r in _all(spark, tmp_path, on_error="skip").collect()] == ["x"]
    with pytest.raises(Exception, match="FetchError"):
        _all(spark, tmp_path).count()
