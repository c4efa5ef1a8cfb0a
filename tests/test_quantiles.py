import numpy as np
import pytest
from pyspark.sql import functions as F

from resalelens.operators import quantiles, trends


def check(spark, data, ps, definition="linear"):
    df = spark.createDataFrame([(g, v) for g, v in data], "g string, v double")
    got = {r.g: r for r in quantiles.sorted_quantiles(df, "v", ["g"], ps, definition=definition).collect()}
    for g in {g for g, _ in data}:
        vals = np.sort(np.array([v for k, v in data if k == g and v is not None]))
        assert got[g].n == len(vals)
        for i, p in enumerate(ps):
            if not len(vals):
                assert got[g][f"q{i}"] is None
                continue
            at = (len(vals) - 1) * p if definition == "linear" else min(max(len(vals) * p - 0.5, 0.0), len(vals) - 1)
            lo, hi = vals[int(np.floor(at))], vals[int(np.ceil(at))]
            assert got[g][f"q{i}"] == lo + (at - np.floor(at)) * (hi - lo)
    return got


def test_order_key_is_monotone(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=300), 10.0 ** rng.uniform(-308, 308, 300), -(10.0 ** rng.uniform(-308, 308, 300)),
                        2.0 ** np.arange(-1074, 1024, 7), np.nextafter(2.0 ** np.arange(-60, 60), 0), [0.0, 5e-324, 1.7976931348623157e308,
                        -1.7976931348623157e308, float("inf"), float("-inf")]])
    v = np.sort(v)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(len(v), float("nan")), (-1, None)], "i long, v double")
    rows = df.select("i", quantiles.order_key(F.col("v")).alias("k")).orderBy("i").collect()
    assert rows[0].k is None
    keys = [r.k for r in rows[1:]]
    assert keys == sorted(keys) and len(set(keys)) > 0.98 * len(set(v))


def test_refinement_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 5)
    monkeypatch.setattr(quantiles, "BRACKETS", 4)  # many rounds
    rng = np.random.default_rng(11)
    data = [("normal", float(x)) for x in rng.normal(100, 10, 400)]
    data += [("wide", float(x)) for x in 10.0 ** rng.uniform(-300, 300, 150) * rng.choice([-1, 1], 150)]
    data += [("ties", 7.0)] * 200 + [("ties", 8.0)] * 3
    data += [("one", 42.0), ("none", None), ("none", None), ("two", -1.0), ("two", 1.0), ("normal", None)]
    check(spark, data, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
    check(spark, data, [0.25, 0.5, 0.75], "hazen")


def test_null_groups_empty_input_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1.0, 9), (None, 3.0, 9), ("x", 2.0, 9)], "lo string, n double, k int")
    got = {r.lo: (r.n, r.q0) for r in quantiles.sorted_quantiles(df.withColumnRenamed("n", "v"), "v", ["lo"], [0.5]).collect()}
    assert got == {None: (2, 2.0), "x": (1, 2.0)}
    assert quantiles.sorted_quantiles(df.where("false"), "n", ["lo"], [0.5]).count() == 0
    assert trends.global_median(df, "n").first()[0] == 2.0


def test_no_task_holds_a_group(spark):
    """One group of distinct doubles: the last stages see a small share of its rows."""
    n = 60_000
    df = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") * 1.37 + 0.01).alias("v"))
    plan_rows = []
    real = quantiles._inside

    def counted(keyed, ranges, groups):
        out = real(keyed, ranges, groups)
        plan_rows.append((out.count(), ranges.agg(F.max("rows")).first()[0]))
        return out

    quantiles._inside, before = counted, real
    try:
        got = quantiles.sorted_quantiles(df, "v", ["g"], [0.25, 0.5, 0.75]).first()
    finally:
        quantiles._inside = before
    v = np.arange(n) * 1.37 + 0.01
    assert got.q1 == pytest.approx(np.quantile(v, 0.5), rel=1e-15)
    rows, largest = plan_rows[-1]
    assert rows < n / 8 and largest <= quantiles.SMALL
