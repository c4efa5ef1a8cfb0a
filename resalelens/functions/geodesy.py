"""Distances between points given as latitude/longitude degrees.

Two measures:

* ``haversine_m`` -- great circle on the mean-radius sphere, a native
  expression that stays inside whole-stage codegen.
* ``ellipsoid_m`` -- inverse geodesic on the WGS-84 ellipsoid (Vincenty's
  iteration) in built-in functions: a fold over the rounds, which stands
  still once a row has converged.

``bounding_box`` gives a conservative pre-filter so that the iteration runs
only for rows near the point, and so that parquet scans can skip row groups
by their min/max statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from resalelens.schemas import EARTH_RADIUS_M, WGS84_A, WGS84_F

# Shortest distance per degree of latitude on WGS-84 (at the equator).
_MIN_M_PER_DEG_LAT = 110574.0
# Padding over the bound: the sphere and the ellipsoid differ by < 0.6 %.
_PAD = 1.01


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres on a sphere of ``radius``."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(h))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str,
                  radius: float = EARTH_RADIUS_M) -> str:
    """The same formula as SQL text (for the oracle and ``selectExpr``)."""
    return (
        f"({2 * radius!r} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def bounding_box(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> Column:
    """Conservative box around ``(lat0, lon0)``: every point within
    ``radius_m`` (sphere or ellipsoid) passes.  Longitude is left open near
    the poles and across the antimeridian."""
    dlat = radius_m / _MIN_M_PER_DEG_LAT * _PAD
    cond = lat.between(lat0 - dlat, lat0 + dlat)
    lat_edge = abs(lat0) + dlat
    if lat_edge < 89.0:
        m_per_deg_lon = math.pi / 180 * WGS84_A * math.cos(math.radians(lat_edge)) * 0.995
        dlon = radius_m / m_per_deg_lon * _PAD
        if dlon < 180 and -180 <= lon0 - dlon and lon0 + dlon <= 180:
            cond = cond & lon.between(lon0 - dlon, lon0 + dlon)
    return cond


#: Iterations of the inverse solution at most; points away from the antipode need about five.
MAX_ITER = 100
#: Change of the longitude (radians) at which the iteration stops: 0.006 mm.
TOLERANCE = 1e-12


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _on_sphere(p: Column, lam: Column, body) -> Column:
    """``body(g)`` with ``g`` the geometry on the auxiliary sphere at longitude difference ``lam``:
    sine, cosine and size of the arc, the azimuth at the equator and the arc's midpoint."""
    def arc(c: Column) -> Column:
        across, along = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * c
        return F.struct(F.sqrt(across * across + along * along).alias("sin"),
                        (p["s1"] * p["s2"] + p["c1"] * p["c2"] * c).alias("cos"))

    def azimuth(g: Column) -> Column:
        sin_alpha = F.when(g["sin"] == 0, 0.0).otherwise(p["c1"] * p["c2"] * F.sin(lam) / g["sin"])
        return _let(sin_alpha, lambda x: F.struct(
            g["sin"].alias("sin"), g["cos"].alias("cos"), F.atan2(g["sin"], g["cos"]).alias("arc"),
            x.alias("sin_alpha"), (1 - x * x).alias("cos2_alpha")))

    def midpoint(g: Column) -> Column:
        m = F.when(g["cos2_alpha"] == 0, 0.0).otherwise(g["cos"] - 2 * p["s1"] * p["s2"] / g["cos2_alpha"])
        return _let(m, lambda x: body(g, x))

    return _let(_let(F.cos(lam), arc), lambda g: _let(azimuth(g), midpoint))


def ellipsoid_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Geodesic distance on WGS-84 in metres: Vincenty's inverse solution in built-in functions.

    Null where a coordinate is null, and where the iteration does not converge
    (nearly antipodal points): no distance rather than a wrong one.
    """
    f = WGS84_F
    a, b = WGS84_A, WGS84_A * (1 - WGS84_F)

    def reduced(lat: Column) -> Column:
        return F.atan((1 - f) * F.tan(F.radians(lat.cast("double"))))

    def step(p: Column, lam: Column) -> Column:
        def moved(g: Column, m: Column) -> Column:
            c = f / 16 * g["cos2_alpha"] * (4 + f * (4 - 3 * g["cos2_alpha"]))
            return _let(c, lambda c: p["lon"] + (1 - c) * f * g["sin_alpha"] * (
                g["arc"] + c * g["sin"] * (m + c * g["cos"] * (2 * m * m - 1))))

        return _on_sphere(p, lam, moved)

    def solve(p: Column) -> Column:
        start = F.struct(p["lon"].alias("lam"), p["lon"].isNull().alias("done"))

        def advance(s: Column, _: Column) -> Column:
            return F.when(s["done"], s).otherwise(_let(step(p, s["lam"]), lambda x: F.struct(
                x.alias("lam"), F.coalesce(F.abs(x - s["lam"]) < TOLERANCE, F.lit(True)).alias("done"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_ITER)), start, advance,
                           lambda s: F.when(s["done"], _on_sphere(p, s["lam"], length)))

    def length(g: Column, m: Column) -> Column:
        def series(u: Column) -> Column:
            big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            return _let(big_b, lambda k: b * big_a * (g["arc"] - k * g["sin"] * (m + k / 4 * (
                g["cos"] * (2 * m * m - 1) - k / 6 * m * (4 * g["sin"] * g["sin"] - 3) * (4 * m * m - 3)))))

        return F.when(g["sin"] == 0, F.when(g["cos"] > 0, 0.0)).otherwise(
            _let(g["cos2_alpha"] * ((a * a - b * b) / (b * b)), series))

    u1, u2 = reduced(lat1), reduced(lat2)
    return _let(F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"),
                         F.radians(lon2.cast("double") - lon1.cast("double")).alias("lon")), solve)


def ellipsoid_sql(points: str, key: str, lat: str, lon: str, lat0: float, lon0: float) -> str:
    """The inverse solution as CTEs for the oracle: ``geo_dist(key, dist)`` of the table ``points``
    from one point, the iteration written as a recursion over rounds."""
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    sphere = """sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) as ss,
        s1 * s2 + c1 * c2 * cos(lam) as cs"""
    alpha = "case when ss = 0 then 0 else c1 * c2 * sin(lam) / ss end as sa"
    mid = "case when sa * sa = 1 then 0 else cs - 2 * s1 * s2 / (1 - sa * sa) end as m, 1 - sa * sa as c2a"
    cc = f"({f!r} / 16 * c2a * (4 + {f!r} * (4 - 3 * c2a)))"
    return f"""geo_in as (select {key} as k, sin(u1) as s1, cos(u1) as c1, sin(u2) as s2, cos(u2) as c2, l from (
    select {key}, atan((1 - {f!r}) * tan(radians({lat}))) as u1, atan((1 - {f!r}) * tan(radians({lat0!r}))) as u2,
      radians({lon0!r} - {lon}) as l from {points})),
geo_it as (select *, l as lam, 0 as i, cast(1 as double) as moved from geo_in
  union all
  select k, s1, c1, s2, c2, l, nxt, i + 1, abs(nxt - lam) from (
    select *, l + (1 - {cc}) * {f!r} * sa * (atan2(ss, cs) + {cc} * ss * (m + {cc} * cs * (2 * m * m - 1))) as nxt from (
      select *, {mid} from (select *, {alpha} from (select *, {sphere} from geo_it where moved >= {TOLERANCE!r} and i < {MAX_ITER}))))),
geo_end as (select * from geo_it where moved < {TOLERANCE!r}),
geo_arc as (select *, c2a * {(a * a - b * b) / (b * b)!r} as u from (
    select *, {mid} from (select *, {alpha} from (select *, {sphere} from geo_end)))),
geo_ab as (select *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) as ga,
    u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) as gb from geo_arc),
geo_dist as (select k as {key}, case when ss = 0 then 0 else {b!r} * ga * (atan2(ss, cs) - gb * ss * (m + gb / 4 * (
    cs * (2 * m * m - 1) - gb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) end as dist from geo_ab)"""
