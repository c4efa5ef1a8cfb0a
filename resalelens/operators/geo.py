"""Points within / outside a radius of a location.

``method="ellipsoid"`` (default) measures on WGS-84, ``method="sphere"`` by
the haversine; both are built-in expressions.  For ``within_radius`` a
bounding-box filter runs first, so that the iteration sees candidate rows
only and parquet can skip row groups.  Rows
without usable coordinates are in neither result.  Where the ellipsoid
iteration does not converge (nearly antipodal points) a row is outside with a
null ``dist`` if the haversine, less its error, is beyond the radius;
``method="geodesic"`` is the same measure with a distance there too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resalelens.functions.numeric import round_half_away
from resalelens.operators.clean import as_double
from resalelens.functions.antipodal import geodesic_m
from resalelens.functions.geodesy import bounding_box, ellipsoid_m, haversine_m


#: The sphere's distance is off the ellipsoid's by less than this share (0.56 % at most).
_SPHERE_ERROR = 0.01


def _coords(df: DataFrame, lat: str, lon: str) -> DataFrame:
    # Coordinates may arrive as text: parse leniently.
    return df.withColumns({lat: as_double(df, lat), lon: as_double(df, lon)}).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def _dist(lat: str, lon: str, lat0: float, lon0: float, method: str):
    a, b = F.lit(float(lat0)), F.lit(float(lon0))
    if method == "ellipsoid":
        return ellipsoid_m(F.col(lat), F.col(lon), a, b)
    if method == "sphere":
        return haversine_m(F.col(lat), F.col(lon), a, b)
    if method == "geodesic":
        return geodesic_m(F.col(lat), F.col(lon), a, b)
    raise ValueError("method must be 'ellipsoid', 'geodesic' or 'sphere'")


def with_distance(df: DataFrame, point: tuple[float, float], method: str = "ellipsoid",
                  lat: str = "LATITUDE", lon: str = "LONGITUDE") -> DataFrame:
    """Add ``dist`` (metres) from ``point`` = (lat, lon)."""
    return _coords(df, lat, lon).withColumn("dist", _dist(lat, lon, point[0], point[1], method))


def within_radius(df: DataFrame, point: tuple[float, float], radius: float = 1000.0,
                  method: str = "ellipsoid", lat: str = "LATITUDE", lon: str = "LONGITUDE") -> DataFrame:
    """G1: rows with ``dist <= radius``, ``dist`` added."""
    cand = _coords(df, lat, lon).where(bounding_box(F.col(lat), F.col(lon), point[0], point[1], radius))
    return (cand.withColumn("dist", _dist(lat, lon, point[0], point[1], method))
            .where(F.col("dist") <= F.lit(float(radius))))


def outside_radius(df: DataFrame, point: tuple[float, float], radius: float = 1000.0,
                   method: str = "ellipsoid", lat: str = "LATITUDE", lon: str = "LONGITUDE") -> DataFrame:
    """Rows with ``dist > radius``, ``dist`` added (null where it does not converge, see above)."""
    r = F.lit(float(radius))
    usable = F.col(lat).between(-90, 90) & F.col(lon).between(-360, 360)
    # Lazy: the haversine is evaluated for the rows without a distance only.
    beyond = F.when(F.col("dist").isNull() & usable, _dist(lat, lon, *point, "sphere") * (1 - _SPHERE_ERROR) > r)
    return with_distance(df, point, method, lat, lon).where(F.coalesce(F.col("dist") > r, beyond))


def proximity_list(df: DataFrame, point: tuple[float, float], radius: float = 1000.0,
                   method: str = "ellipsoid", name: str = "loc_info") -> DataFrame:
    """Names within the radius, nearest first, with ``dist`` rounded to
    metres and the listing text ``To <name> - 1,234m`` (ties by name)."""
    w = within_radius(df, point, radius, method)
    d = round_half_away("dist", 0)
    return w.select(
        F.col(name).alias(name), d.alias("dist_m"),
        F.concat(F.lit("To "), F.col(name), F.lit(" - "), F.format_number(d, 0), F.lit("m")).alias("text"),
    ).orderBy("dist_m", name)
