from pyspark.sql import functions as F

from conftest import rows
from resalelens.functions.antipodal import geodesic_m, halved_m, near_antipode
from resalelens.functions.geodesy import ellipsoid_m, haversine_m
from resalelens.operators import geo

PT = (1.3521, 103.8198)


def points(spark):
    data = [
        ("same", "1.3521", "103.8198"),
        ("near", "1.3600", "103.8198"),
        ("far", "1.5000", "104.0000"),
        ("nolat", None, "103.8"),
        ("text", "abc", "103.8"),
    ]
    return spark.createDataFrame(data, "loc_info string, LATITUDE string, LONGITUDE string")


def test_within_and_outside_partition_rows_with_coordinates(spark):
    df = points(spark)
    for method in ("sphere", "ellipsoid"):
        w = {r.loc_info: r.dist for r in geo.within_radius(df, PT, 1000, method).collect()}
        o = {r.loc_info for r in geo.outside_radius(df, PT, 1000, method).collect()}
        assert set(w) == {"same", "near"} and o == {"far"}
        assert w["same"] == 0.0


def test_point_exactly_on_radius_is_inside(spark):
    df = spark.createDataFrame([("edge", 1.3600, 103.8198)], "loc_info string, LATITUDE double, LONGITUDE double")
    d = df.select(haversine_m(F.col("LATITUDE"), F.col("LONGITUDE"), F.lit(PT[0]), F.lit(PT[1]))).first()[0]
    assert geo.within_radius(df, PT, d, "sphere").count() == 1
    assert geo.outside_radius(df, PT, d, "sphere").count() == 0


def test_ellipsoid_and_sphere_close(spark):
    df = points(spark)
    e = {r.loc_info: r.dist for r in geo.with_distance(df, PT, "ellipsoid").collect()}
    s = {r.loc_info: r.dist for r in geo.with_distance(df, PT, "sphere").collect()}
    assert abs(e["far"] - s["far"]) / s["far"] < 0.006


def test_bounding_box_never_drops_a_point_in_radius(spark):
    import random
    rnd = random.Random(3)
    data = [(str(i), 1.3521 + rnd.uniform(-0.2, 0.2), 103.8198 + rnd.uniform(-0.2, 0.2)) for i in range(2000)]
    df = spark.createDataFrame(data, "loc_info string, LATITUDE double, LONGITUDE double")
    with_box = geo.within_radius(df, PT, 15000, "ellipsoid").count()
    brute = geo.with_distance(df, PT, "ellipsoid").where("dist <= 15000").count()
    assert with_box == brute > 0


def test_proximity_list_text(spark):
    out = geo.proximity_list(points(spark), PT, 1000, "sphere").collect()
    assert out[0].text == "To same - 0m"
    assert out[1].text.startswith("To near - ") and out[1].text.endswith("m")


def test_antipodal_rows_are_outside(spark):
    data = [("antipode", -PT[0], PT[1] - 180), ("nearly", -PT[0] + 0.1, PT[1] - 179.7), ("near", 1.36, 103.8198),
            ("nan", float("nan"), 103.8), ("nan lon", 1.3, float("nan")), ("off", 95.0, 1.0)]
    df = spark.createDataFrame(data, "loc_info string, LATITUDE double, LONGITUDE double")
    out = {r.loc_info: r.dist for r in geo.outside_radius(df, PT, 1000).collect()}
    assert {k: out[k] for k in ("antipode", "nearly")} == {"antipode": None, "nearly": None}
    assert "near" not in out and "nan" not in out and "nan lon" not in out
    # Not surely beyond: a radius of about half the way round.
    assert "antipode" not in {r.loc_info for r in geo.outside_radius(df, PT, 20_000_000).collect()}


#: Published inverse solutions on WGS-84 (lat 1, lon 1, lat 2, lon 2, metres).
PUBLISHED = [
    (-30.0, 0.0, 29.9, 179.8, 19989832.82761),
    (0.0, 0.0, 0.5, 179.5, 19936288.579),
    (0.0, 0.0, 0.5, 179.7, 19944127.421),
    (90.0, 0.0, -90.0, 0.0, 20003931.4586),
    (0.0, 0.0, 0.0, 180.0, 20003931.4586),
]


def test_geodesic_near_the_antipode(spark):
    df = spark.createDataFrame(PUBLISHED, "a double, b double, c double, d double, m double")
    there = geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    back = geodesic_m(F.col("c"), F.col("d"), F.col("a"), F.col("b") - 360)
    for m, x, y in rows(df.select("m", there, back)):
        assert abs(m - x) < 0.001 and abs(m - y) < 0.001


def test_halving_agrees_with_the_iteration_where_both_hold(spark):
    import random
    rnd = random.Random(4)
    pts = [(rnd.uniform(-89, 89), rnd.uniform(-180, 180), rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for _ in range(400)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    for h, v in rows(df.select(halved_m(*c), ellipsoid_m(*c)).where(~near_antipode(*c))):
        assert abs(h - v) < 0.001


def test_geodesic_method_has_a_distance_for_antipodal_rows(spark):
    data = [("antipode", -PT[0], PT[1] - 180), ("nearly", -PT[0] + 0.1, PT[1] - 179.7), ("near", 1.36, 103.8198),
            ("nan", float("nan"), 103.8), ("null", None, 103.8), ("off", 95.0, 1.0)]
    df = spark.createDataFrame(data, "loc_info string, LATITUDE double, LONGITUDE double")
    out = {r.loc_info: r.dist for r in geo.outside_radius(df, PT, 1000, "geodesic").collect()}
    assert abs(out["antipode"] - 20003931.4586) < 0.001 and 19_900_000 < out["nearly"] < out["antipode"]
    assert "near" not in out and "null" not in out and "nan" not in out
    inside = {r.loc_info for r in geo.within_radius(df, PT, 20_003_932, "geodesic").collect()}
    assert {"antipode", "nearly", "near"} <= inside
