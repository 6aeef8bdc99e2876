"""Distances, coordinate normalisation and ring geometry as Column expressions. Angles are degrees unless stated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
PAIRWISE_KM = 6372.8
ONE_TO_MANY_KM = 6371.4
KERNEL_KM = 500.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the atan2 form; what rounding lifts above one is clamped."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km_asin(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = PAIRWISE_KM, floor: float = 0.0) -> Column:
    """The arcsine form. ``floor`` is added under the root (1e-16 for one point against a set)."""
    a = F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a + floor, F.lit(1.0))))


def euclidean(x: Column, y: Column) -> Column:
    """Distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def geo_kernel(km: Column, scale: float = KERNEL_KM) -> Column:
    return F.exp(-km / scale)


def normalize_global(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon / 180.0, lat / 90.0


def normalize_extent(lon: Column, lat: Column, extent: tuple[float, float, float, float] | None = None) -> tuple[Column, Column]:
    """Min-max by (x0, x1, y0, y1) to [-1, 1]; None is the global form."""
    if extent is None:
        return normalize_global(lon, lat)
    x0, x1, y0, y1 = extent
    return (lon - x0) / (x1 - x0) * 2 - 1, (lat - y0) / (y1 - y0) * 2 - 1


def ring_bounds(ring: Column) -> Column:
    """struct(x0, x1, y0, y1) of an array of struct(lon, lat)."""
    xs, ys = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def ring_centroid(ring: Column) -> Column:
    """struct(lon, lat): area-weighted centroid of a closed ring (first point repeated last)."""
    edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"]
    total = lambda f: F.aggregate(F.transform(edges, f), F.lit(0.0), lambda s, v: s + v)
    twice = total(cross)
    return F.struct(
        (total(lambda e: (e["p"]["lon"] + e["q"]["lon"]) * cross(e)) / (3 * twice)).alias("lon"),
        (total(lambda e: (e["p"]["lat"] + e["q"]["lat"]) * cross(e)) / (3 * twice)).alias("lat"),
    )


PI = math.pi
