"""Geodesic distance that also converges near the antipode.

The longitude at which a geodesic that leaves point 1 at azimuth ``alpha``
meets the latitude of point 2 grows with ``alpha`` once the points are turned so that
point 1 is the one farther from the equator and lies south of it, and point 2 to its
east.  The azimuth is therefore found by halving its bracket: ``HALVINGS`` rounds, each
always right, where the usual fixed-point iteration over the longitude swings or
leaves the range.  Longitude and length are integrals over the arc on the auxiliary
sphere,

    lon = omega - f sin(a0) * int (2 - f) / (1 + (1 - f) sqrt(1 + k^2 sin^2 s)) ds
    length = b * int sqrt(1 + k^2 sin^2 s) ds

whose integrands are nearly constant (k^2 < 0.007): ``NODES`` Gauss-Legendre nodes give all
digits of a double.  Everything is built-in column math; ``geodesic_sql`` says the same in SQL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from resalelens.functions.geodesy import _let, ellipsoid_m
from resalelens.schemas import WGS84_A, WGS84_F

#: Halvings of the azimuth's bracket (pi / 2^60 is below a double's spacing at pi).
HALVINGS = 60
#: Nodes of the quadrature.
NODES = 14
#: Points nearer than this to the antipode (degrees on the sphere) are solved by halving; the
#: other iteration fails within 0.61 degrees of it only.
NEAR = 2.0
#: Stands for a latitude of zero, south of the equator.
_TINY = 1e-150

_B = WGS84_A * (1 - WGS84_F)
_EP2 = WGS84_F * (2 - WGS84_F) / (1 - WGS84_F) ** 2


def _quadrature() -> list[tuple[float, float]]:
    """Nodes and weights on 0..1."""
    t, w = np.polynomial.legendre.leggauss(NODES)
    return [(float((x + 1) / 2), float(v / 2)) for x, v in zip(t, w)]


def _gap(lon1: Column, lon2: Column) -> Column:
    """Difference of longitudes in radians, 0..pi."""
    turn = F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0
    return F.radians(F.abs(turn))


def near_antipode(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether the points are within ``NEAR`` degrees of opposite each other."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(_gap(lon1, lon2)) < -math.cos(math.radians(NEAR))


def halved_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Length in metres by halving the azimuth; right for any two points that are not both on
    the equator with an equatorial geodesic, null where a coordinate is null, NaN or no latitude."""
    usable = lat1.between(-90, 90) & lat2.between(-90, 90) & (F.abs(lon2 - lon1) < float("inf"))

    def sine_and_cosine(lat: Column) -> Column:
        return _let(F.atan((1 - WGS84_F) * F.tan(F.radians(lat))), lambda u: F.struct(F.sin(u).alias("s"), F.cos(u).alias("c")))

    def turned(e: Column) -> Column:
        swap = F.abs(e["one"]["s"]) < F.abs(e["two"]["s"])
        far, other = F.when(swap, e["two"]).otherwise(e["one"]), F.when(swap, e["one"]).otherwise(e["two"])
        flip = F.when(far["s"] > 0, -1.0).otherwise(1.0)
        return F.struct(F.least(far["s"] * flip, F.lit(-_TINY)).alias("s1"), far["c"].alias("c1"),
                        (other["s"] * flip).alias("s2"), other["c"].alias("c2"), e["gap"].alias("gap"))

    def path(p: Column, alpha: Column, body) -> Column:
        """``body(g)`` with the arc's ends, its longitudes on the sphere and ``k^2`` for an azimuth."""
        def ends(g: Column) -> Column:
            rest = F.when(p["c1"] < -p["s1"], (p["c2"] - p["c1"]) * (p["c1"] + p["c2"])).otherwise(
                (p["s1"] - p["s2"]) * (p["s1"] + p["s2"]))
            q = F.sqrt(F.greatest(g["u"] * g["u"] + rest, F.lit(0.0)))
            return _let(q, lambda q: F.struct(
                g["a0"].alias("a0"), (_EP2 * (g["c"] * g["c"] + F.pow(g["s"] * p["s1"], 2))).alias("k2"),
                F.atan2(p["s1"], g["u"]).alias("from"), F.atan2(p["s2"], q).alias("to"),
                (F.atan2(g["a0"] * p["s2"], q) - F.atan2(g["a0"] * p["s1"], g["u"])).alias("omega")))

        first = F.struct(F.sin(alpha).alias("s"), F.cos(alpha).alias("c"))
        start = _let(first, lambda h: F.struct(h["s"].alias("s"), h["c"].alias("c"), (h["s"] * p["c1"]).alias("a0"),
                                               (h["c"] * p["c1"]).alias("u")))
        return _let(_let(start, ends), body)

    def integral(g: Column, of) -> Column:
        span = g["to"] - g["from"]
        parts = [w * of(F.sqrt(1 + g["k2"] * F.pow(F.sin(g["from"] + t * span), 2))) for t, w in _quadrature()]
        return span * sum(parts[1:], parts[0])

    def longitude(g: Column) -> Column:
        return g["omega"] - WGS84_F * g["a0"] * integral(g, lambda r: (2 - WGS84_F) / (1 + (1 - WGS84_F) * r))

    def solve(p: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            return _let(mid, lambda m: _let(path(p, m, longitude), lambda lon: F.struct(
                F.when(lon < p["gap"], m).otherwise(s["lo"]).alias("lo"),
                F.when(lon < p["gap"], s["hi"]).otherwise(m).alias("hi"))))

        bracket = F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), bracket, halve,
                           lambda s: path(p, (s["lo"] + s["hi"]) / 2, lambda g: _B * integral(g, lambda r: r)))

    both = F.struct(sine_and_cosine(lat1).alias("one"), sine_and_cosine(lat2).alias("two"), _gap(lon1, lon2).alias("gap"))
    return F.when(usable, _let(_let(both, turned), solve))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Geodesic distance on WGS-84 in metres for any two points; null without usable coordinates."""
    lat1, lon1, lat2, lon2 = (c.cast("double") for c in (lat1, lon1, lat2, lon2))
    return F.when(near_antipode(lat1, lon1, lat2, lon2), halved_m(lat1, lon1, lat2, lon2)).otherwise(
        ellipsoid_m(lat1, lon1, lat2, lon2))


def geodesic_sql(points: str, key: str, lat: str, lon: str, lat0: float, lon0: float) -> str:
    """``halved_m`` as CTEs for the oracle: ``far_dist(key, dist)`` of the table ``points`` from one point."""
    f = WGS84_F

    def u(of: str) -> str:
        return f"atan((1 - {f!r}::double) * tan(radians({of})))"

    root = "sqrt(1 + k2 * pow(sin(s_from + {t!r}::double * (s_to - s_from)), 2))"
    lon_of = " + ".join(f"{w!r}::double * ({2 - f!r}::double) / (1 + {1 - f!r}::double * {root.format(t=t)})" for t, w in _quadrature())
    len_of = " + ".join(f"{w!r}::double * {root.format(t=t)}" for t, w in _quadrature())

    def path(table: str) -> str:
        return f"""(select *, {_EP2!r}::double * (pow(cos(al), 2) + pow(sin(al) * s1, 2)) as k2, sin(al) * c1 as a0,
      atan2(s1, cos(al) * c1) as s_from, atan2(s2, q) as s_to,
      atan2(sin(al) * c1 * s2, q) - atan2(sin(al) * c1 * s1, cos(al) * c1) as om from (
      select *, sqrt(greatest(pow(cos(al) * c1, 2) + case when c1 < -s1 then (c2 - c1) * (c1 + c2)
        else (s1 - s2) * (s1 + s2) end, 0)) as q from (select *, (lo + hi) / 2 as al from {table})))"""

    return f"""far_in as (select k, least(-abs(sa), {-_TINY!r}::double) as s1, ca as c1, case when sa > 0 then -sb else sb end as s2, cb as c2, gap from (
    select k, gap, case when sw then v else u end as ua, case when sw then u else v end as ub,
      sin(ua) as sa, cos(ua) as ca, sin(ub) as sb, cos(ub) as cb from (
      select *, abs(sin(u)) < abs(sin(v)) as sw from (
        select {key} as k, {u(lat)} as u, {u(repr(lat0))} as v,
          radians(abs(({lon0!r} - {lon} + 900) % 360 - 180)) as gap from {points})))),
far_it as (select *, 0 as i, 0::double as lo, {math.pi!r}::double as hi from far_in
  union all
  select k, s1, c1, s2, c2, gap, i + 1, case when ln < gap then al else lo end, case when ln < gap then hi else al end from (
    select *, om - {f!r}::double * a0 * (s_to - s_from) * ({lon_of}) as ln from {path("far_it")} where i < {HALVINGS})),
far_dist as (select k as {key}, {_B!r}::double * (s_to - s_from) * ({len_of}) as dist from {path("far_it")} where i = {HALVINGS})"""
