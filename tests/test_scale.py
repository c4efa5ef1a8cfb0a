"""Plans and files whose size must not follow the rows: quantiles, box statistics, envelopes, documents, tables, sink."""
import contextlib
import gzip
import io
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from resalelens.functions.text import rewrite_column
from resalelens.operators import boxstats, quantiles
from resalelens.plans import catalog
from resalelens.plans.materialize import table_location
from resalelens.plans.standin import _month
from resalelens.sources import envelope
from resalelens.sources import month_source as M
from resalelens.sources import record_files as R


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_brackets_are_counted_without_sorting_the_rows(spark):
    keyed = spark.range(100).select((F.col("id") % 2).alias("g0"), F.col("id").cast("double").alias("v"), F.col("id").alias("k"))
    ranges = spark.createDataFrame([(g, 0, 99, 0, 50, 50, [25]) for g in (0, 1)], "g0 long, lo long, hi long, below long, rows long, n long, ranks array<long>")
    cut = quantiles._refined(keyed, ranges, ["g0"])
    assert sorted((r.g0, r.lo, r.below, r.rows) for r in cut.collect()) == [(0, 50, 25, 1), (1, 51, 25, 1)]
    assert "SortAggregate" not in _plan(cut)


def test_box_stats_holds_no_values(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", None), (None, 5.0), (None, -0.0)], "g string, v double")
    out = boxstats.box_stats(df, "v", ["g"])
    got = {r.g: (r.n, r.lower_whisker, r.upper_whisker, r.n_outliers) for r in out.collect()}
    assert got == {"a": (5, 1.0, 4.0, 1), "b": (0, None, None, 0), None: (2, 0.0, 5.0, 0)}
    assert not any("Aggregate" in line and "keys=[g" in line and ", v" in line.split("keys=")[1].split("]")[0] for line in _plan(out).splitlines())


def test_envelopes_are_compressed_and_shuffled_once(spark, tmp_path):
    rows = spark.range(0, 5000, numPartitions=3).select(
        F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("2024-0"), F.col("id") % 2 + 1)).alias("month"), F.col("id").cast("string").alias("town"))
    path = str(tmp_path / "env")
    envelope.write_envelopes(rows, path, page_size=100)
    files = [p for p in (tmp_path / "env").rglob("part-*")]
    assert files and all(p.suffix == ".gz" for p in files)
    sizes = [len(json.loads(line)["result"]["records"]) for p in files for line in gzip.open(p, "rt")]
    assert max(sizes) <= 100 and sum(sizes) == 5000
    schema = T.StructType([T.StructField("month", T.StringType()), T.StructField("town", T.StringType())])
    back = envelope.read_envelopes(spark, path, schema)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_compressed_pages_from_any_cursor(tmp_path):
    d = tmp_path / "month=2024-01"
    d.mkdir()
    names = [f"t{i}" for i in range(40)]
    for f, at in (("a", 0), ("b", 20)):
        with gzip.open(d / f"{f}.json.gz", "wt") as out:
            for k in range(at, at + 20, 7):
                records = [{"month": "2024-01", "town": t} for t in names[k:min(k + 7, at + 20)]]
                out.write(json.dumps({"result": {"records": records}}) + "\n")
    pages = M.StoredPages.__new__(M.StoredPages)
    pages.path, pages.required = tmp_path.as_uri(), {}
    got, cursors, cursor = [], [], None
    while True:
        cursors.append(cursor)
        M._envelope.cache_clear()
        records, cursor = pages.page("2024-01", ["town"], None, cursor, 3)
        got.append([r["town"] for r in records])
        if cursor is None:
            break
    assert sum(got, []) == names
    for cursor, page in reversed(list(zip(cursors, got))):  # backwards, from the start of the file each time
        M._envelope.cache_clear()
        assert [r["town"] for r in pages.page("2024-01", ["town"], None, cursor, 3)[0]] == page
    assert [r["town"] for r in pages("2024-01", ["town"], None)] == names


def test_rows_are_finished_after_the_shuffle(spark, tmp_path):
    (tmp_path / "in").write_text("finish")
    schema = T.StructType([T.StructField("month", T.StringType()), T.StructField("y", T.LongType())])
    seen = []

    def finish(df):
        seen.append((df.columns, "Rebalance" in df._jdf.queryExecution().analyzed().toString()))
        return df.withColumn("y", F.col("x") * 2)

    at = table_location(spark, "finished", [str(tmp_path / "in")], lambda: spark.createDataFrame([("2024-01", 4)], "month string, x long"), schema, finish=finish)
    assert [tuple(r) for r in spark.read.schema(schema).parquet(at).select("month", "y").collect()] == [("2024-01", 8)]
    assert seen == [(["month", "x"], True)]


def test_trend_reads_no_texts(spark, tmp_path):
    for name, rows, schema in [
            ("lineitem", [(1, 1, 1, 1, 5.0, 40000.0, "1995-03-02", "A"), (2, 1, 1, 2, 5.0, None, None, "A")],
             "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string, l_returnflag string"),
            ("part", [(1, "red bolt", "ECONOMY", 3), (1, "red gear", "PROMO", 4)], "p_partkey long, p_name string, p_type string, p_size int"),
            ("supplier", [(1, 1)], "s_suppkey long, s_nationkey int"), ("nation", [(1, "N")], "n_nationkey int, n_name string")]:
        df = spark.createDataFrame(rows, schema)
        df = df.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")) if name == "lineitem" else df
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    trend = catalog.trend(spark, str(tmp_path))
    # A part that comes twice gives each row twice, as in the clean table.
    assert sorted(map(tuple, trend.collect()), key=repr) == sorted([("1995-03", "N", 400000.0, 1, "300-500k")] * 2 + [(None, "N", None, 1, None)] * 2, key=repr)
    assert all("trend_feed" in f for f in trend.inputFiles())


def test_months_and_first_matches_by_bytes(spark):
    days = spark.sql("select explode(array(timestamp'0001-02-03', timestamp'0999-12-31', timestamp'1995-03-01 23:59:59', timestamp'9999-11-01', null)) as d")
    got = days.select(_month("d").alias("m"), F.date_format("d", "yyyy-MM").alias("w")).collect()
    assert [r.m for r in got] == [r.w for r in got]
    df = spark.createDataFrame([("61 years 04 months",), ("çs s",), ("",), (None,)], "s string")
    got = [r.s for r in rewrite_column(df, "s", [("s", ""), (" year", "y"), (" month", "m")]).collect()]
    assert got == ["61y 04ms", "ç s", "", None]


def test_sink_writes_lines_that_spark_made(spark, tmp_path):
    schema = "`a.b` string, x double, t timestamp"
    df = spark.sql("select 'ü\"\n' as `a.b`, double('NaN') as x, timestamp'2024-01-02 03:04:05' as t union all select null, double('-infinity'), null")
    R.write_committed(df, str(tmp_path / "t"))
    lines = [json.loads(x) for p in (tmp_path / "t" / "data").iterdir() for x in p.read_text().splitlines()]
    assert len(lines) == 2 and all(set(x) == {"a.b", "x", "t"} for x in lines)
    back = R.read_committed(spark, str(tmp_path / "t"), schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
