"""Distances, plausibility and image geometry, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon1, lon2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def kmh(km: Column, seconds: Column) -> Column:
    """Null where no time passed."""
    return F.when(seconds > 0, km / (seconds / 3600.0))


def plausible(km: Column, seconds: Column, max_kmh: float) -> Column:
    return F.when(seconds <= 0, False).otherwise(F.coalesce(kmh(km, seconds) <= max_kmh, F.lit(False)))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes [x1, y1, x2, y2]."""
    zero = F.lit(0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(zero, r[2] - r[0]) * F.greatest(zero, r[3] - r[1])
    union = area(a) + area(b) - w * h
    return F.when((w * h > 0) & (union > 0), w * h / union).otherwise(0.0)


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Ray casting over array<struct<x, y>>; false under three points."""
    n = F.size(points)
    edges = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def crosses(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, F.when(i == 0, n - 1).otherwise(i - 1))
        dy = F.when(q["y"] == p["y"], 1e-12).otherwise(q["y"] - p["y"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / dy + p["x"])

    return F.when(n < 3, False).otherwise(F.size(F.filter(edges, crosses)) % 2 == 1)


def orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(p1, p2, p3, p4) -> Column:
    """Strict change of side on both; each point is a pair of Columns."""
    left = lambda a, b, c: orient(*a, *b, *c) > 0
    return (left(p3, p4, p1) != left(p3, p4, p2)) & (left(p1, p2, p3) != left(p1, p2, p4))


def side_of(line_a, line_b, p) -> Column:
    return F.when(orient(*line_a, *line_b, *p) > 0, "a").otherwise("b")
