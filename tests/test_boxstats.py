import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from resalelens.operators import boxstats


def reference(values, k=1.5):
    v = np.sort(np.asarray(values, dtype=float))
    q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])  # linear interpolation
    lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    inside = v[(v >= lo) & (v <= hi)]
    return dict(n=len(v), q1=q1, median=med, q3=q3, lower_whisker=inside.min(), upper_whisker=inside.max(),
                n_outliers=int(((v < lo) | (v > hi)).sum()))


def test_box_stats_against_numpy(spark):
    rng = np.random.default_rng(7)
    data = [("a", float(x)) for x in rng.normal(100, 10, 501)] + [("a", 500.0), ("a", -300.0)]
    data += [("b", float(x)) for x in rng.exponential(5, 200)]
    data += [("c", 42.0)]  # group of one row
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in boxstats.box_stats(df, "v", ["g"]).collect()}
    for g in "abc":
        ref = reference([v for k, v in data if k == g])
        r = got[g]
        for key, val in ref.items():
            assert abs(getattr(r, key) - val) < 1e-9, (g, key)
    assert got["a"].n_outliers >= 2


def test_outlier_rows_match_counts(spark):
    data = [("x", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]] + [("y", 1.0), ("y", None)]
    df = spark.createDataFrame(data, "g string, v double")
    out = boxstats.outliers(df, "v", ["g"]).collect()
    assert [(r.g, r.v) for r in out] == [("x", 100.0)]
    stats = {r.g: r for r in boxstats.box_stats(df, "v", ["g"]).collect()}
    assert stats["x"].n_outliers == 1 and stats["y"].n == 1


def test_cutoff_and_rows_at_or_below(spark):
    data = [("m", float(v)) for v in range(1, 11)]
    df = spark.createDataFrame(data, "month string, price double")
    c = boxstats.cutoff(df, "price", ["month"], 0.1).first().cutoff
    assert abs(c - np.quantile(np.arange(1, 11), 0.1)) < 1e-12
    rows = boxstats.at_or_below_cutoff(df, "price", ["month"], 0.1).collect()
    assert [r.price for r in rows] == [1.0]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=40))
def test_box_stats_property(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    r = boxstats.box_stats(df, "v", ["g"]).first()
    ref = reference(values)
    assert r.n == ref["n"] and r.n_outliers == ref["n_outliers"]
    assert abs(r.median - ref["median"]) < 1e-9
    assert r.lower_whisker == ref["lower_whisker"] and r.upper_whisker == ref["upper_whisker"]


def test_hazen_quartiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    data = [("a", float(x)) for x in rng.normal(0, 1, 37)] + [("b", 1.0), ("b", 4.0)] + [("c", 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in boxstats.quartiles(df, "v", ["g"], definition="hazen").collect()}
    for g in "abc":
        vals = np.array([v for k, v in data if k == g])
        ref = np.quantile(vals, [0.25, 0.5, 0.75], method="hazen")
        assert np.allclose([got[g].q1, got[g].median, got[g].q3], ref, rtol=0, atol=1e-12), g
    box = {r.g: r for r in boxstats.box_stats(df, "v", ["g"], definition="hazen").collect()}
    assert box["a"].median == got["a"].median


def test_quantiles_do_not_depend_on_exchange_reuse_and_keep_all_null_groups(spark):
    df = spark.createDataFrame([(g, float(i % 37) if g < 3 else None) for g in range(4) for i in range(400)], "g int, v double")
    found = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        found.append(sorted(tuple(r) for r in boxstats.box_stats(df, "v", ["g"]).collect() if r.g < 3))
        empty = [r for r in boxstats.box_stats(df, "v", ["g"]).collect() if r.g == 3]
        assert [(r.n, r.median, r.n_outliers) for r in empty] == [(0, None, 0)]
    spark.conf.set("spark.sql.exchange.reuse", "true")
    assert found[0] == found[1] and found[0][0][3] == 18.0
