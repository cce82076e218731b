"""Polygon area on the WGS84 ellipsoid under the cylindrical equal-area projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.clean import ColumnLike, _c

# WGS84 semi-major axis in metres and flattening.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def _northing(lat: Column) -> Column:
    """Equal-area northing in metres (Snyder, Map Projections: A Working Manual, eq. 3-12 and 10-15)."""
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))
    return WGS84_A * q / 2


def _ring_area(ring: Column) -> Column:
    """Shoelace area of one ring of (lon, lat) points; closing the ring is optional."""
    points = F.transform(
        ring, lambda p: F.struct((F.radians(F.get(p, F.lit(0))) * WGS84_A).alias("x"), _northing(F.get(p, F.lit(1))).alias("y"))
    )
    nxt = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2


def area_sq_km(geometry: ColumnLike) -> Column:
    """Area in square kilometres of an array of polygons, each an outer ring followed by its holes."""

    def polygon(rings: Column) -> Column:
        areas = F.transform(rings, _ring_area)
        total = F.aggregate(areas, F.lit(0.0), lambda acc, a: acc + a)
        return 2 * F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)) - total  # outer minus holes

    polygons = F.transform(_c(geometry), polygon)
    return F.aggregate(polygons, F.lit(0.0), lambda acc, a: acc + a) / 1_000_000
