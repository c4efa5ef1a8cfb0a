"""Deep pages against a sorted list, the committed sink, number text and data-driven years."""

import random

import pytest
from pyspark.sql import functions as F

from resalelens.operators import analyses, paging, search
from resalelens.sources import record_files as R


def _sorted(rows, cols, keys):
    out = list(rows)
    for name, up in reversed(keys):
        at = cols.index(name)
        out.sort(key=lambda r: (r[at] is not None, r[at] if r[at] is not None else 0 if not isinstance(r[at], str) else ""), reverse=not up)
    return out


@pytest.mark.parametrize("keys", [
    [("price", False), ("street", True), ("id", True)], [("price", True), ("street", False), ("id", False)],
    [("street", True), ("id", True)], [("street", False), ("price", True), ("id", True)], [("big", True), ("id", True)], [("id", False)]])
def test_deep_pages_match_a_sorted_list(spark, monkeypatch, keys):
    monkeypatch.setattr(paging, "SHALLOW", 0)
    monkeypatch.setattr(paging, "SMALL", 8)
    monkeypatch.setattr(paging, "BRACKETS", 5)
    rng = random.Random(2)
    streets = [None, "", "BLK 1 ALPHA STREET NORTH", "BLK 1 ALPHA STREET NORTH 2", "BLK 1 ALPHA STREET", "Ä", "z", "BLK 1 ALPHA STREET NORTH 10"]
    rows = [(i, rng.choice([None, 1.0, 2.0, 2.0, 2.0, 1e300, -1e-300, rng.random()]), rng.choice(streets), (1 << 60) + rng.randint(0, 40))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, price double, street string, big long")
    want = _sorted(rows, df.columns, keys)
    for offset, size in ((1, 3), (149, 20), (280, 50), (299, 1), (300, 5), (100, 0)):
        got = [tuple(r) for r in paging.sorted_page(df, keys, offset, size).collect()]
        assert got == want[offset:offset + size], (offset, size)


def test_a_deep_page_sorts_about_one_bracket(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("id"), F.lit("x").alias("s"))
    first = paging._end(df, [("id", True)], 150_000)
    assert df.where(paging._beyond(first, True) & paging._beyond(first, False)).count() <= paging.SMALL
    got = search.page(df, "id", True, offset=150_000, size=20)
    assert [r.id for r in got.collect()] == list(range(150_000, 150_020))
    assert [r.id for r in search.page(df, "id", False, offset=5, size=3).collect()] == [199_994, 199_993, 199_992]


SCHEMA = "month string, price double, n long"
ROWS = [("2024-01", 1.5, 1), ("2024-02", None, 2), (None, 3.25, 3), ("a\n\"ü", 1e300, 4)]


def test_committed_records_read_back(spark, tmp_path):
    path = str(tmp_path / "t")
    assert R.read_committed(spark, path, SCHEMA).count() == 0
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    R.write_committed(df, path)
    assert sorted(map(tuple, R.read_committed(spark, path, SCHEMA).collect()), key=repr) == sorted(ROWS, key=repr)
    R.write_committed(df, path)
    assert R.read_committed(spark, path, SCHEMA).count() == 8
    R.write_committed(df.limit(1), path, "overwrite")
    assert R.read_committed(spark, path, SCHEMA).count() == 1
    R.write_committed(df, path)
    assert R.read_committed(spark, path, SCHEMA).count() == 5


def test_tasks_that_fail_or_run_twice_leave_each_record_once(spark, tmp_path):
    import pyarrow as pa

    path = (tmp_path / "t").as_uri()
    batch = pa.RecordBatch.from_pydict({"month": ["a", "b"], "price": [1.0, 2.0], "n": [1, 2]})
    writer = R.RecordWriter(path, overwrite=False)

    def lost():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(lost())
    assert list((tmp_path / "t" / "data").iterdir()) == []
    twice = [writer.write(iter([batch])), writer.write(iter([batch]))]  # a speculative attempt beside the first
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert R.read_committed(spark, path, SCHEMA).count() == 0  # nothing is committed yet
    writer.commit([twice[1], None])
    assert sorted(r.n for r in R.read_committed(spark, path, SCHEMA).collect()) == [1, 2]
    other = writer.write(iter([batch]))
    writer.abort([other, None])
    assert R.read_committed(spark, path, SCHEMA).count() == 2
    # What a killed attempt left half written is never read.
    (tmp_path / "t" / "data" / "part-00000-half.jsonl").write_text('{"month": "x", "pri')
    assert R.read_committed(spark, path, SCHEMA).count() == 2


def test_a_failing_job_commits_nothing(spark, tmp_path):
    df = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("bad row"))).otherwise("2024-01").cast("string").alias("month"))
    with pytest.raises(Exception):
        R.write_committed(df, str(tmp_path / "t"))
    assert R.read_committed(spark, str(tmp_path / "t"), "month string").count() == 0


@pytest.mark.parametrize("value,text", [(1234567.5, "1,234,567.5"), (1000000.0, "1,000,000.0"), (0.25, "0.25"), (-1234.56, "-1,234.56"),
                                        (12345678.9, "12,345,678.9"), (999.0, "999.0"), (100.1, "100.1")])
def test_number_text(spark, value, text):
    assert f"{value:,}" == text
    from resalelens.functions.text import grouped_number
    assert spark.createDataFrame([(value,)], "v double").select(grouped_number(F.col("v"))).first()[0] == text


def test_crosstab_years_come_from_the_data(spark):
    t = spark.createDataFrame([("1990-01", "A", 2e6), ("2024-05", "A", 2e6), ("2024-06", "B", 2e6), ("2024-07", "B", 1.0)],
                              "month string, town string, price double")
    wide = analyses.crosstab_wide(analyses.town_year_crosstab(t))
    assert wide.columns == ["town", "town_total", "1990", "2024", "All"]
    assert [tuple(r) for r in wide.collect()] == [("All", 3, 1, 2, 3), ("A", 2, 1, 1, 2), ("B", 1, None, 1, 1)]
    with pytest.raises(ValueError, match="years"):
        analyses.crosstab_wide(analyses.town_year_crosstab(t), most_years=1)
