"""Distances and planar geometry as Column expressions, with plain twins for use inside partitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres; WGS84 semi-major axis and flattening (fixed values).
EARTH_RADIUS = 6371008.8
WGS84_AXIS, WGS84_FLATTENING = 6378137.0, 1 / 298.257223563
#: Least cosine of a latitude in local scales.
LEAST_COSINE = 1e-6


def haversine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Great-circle metres between two positions in degrees."""
    up, across = F.sin(F.radians(by - ay) / 2), F.sin(F.radians(bx - ax) / 2)
    h = up * up + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * across * across
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_py(ax: float, ay: float, bx: float, by: float) -> float:
    up, across = math.sin(math.radians(by - ay) / 2), math.sin(math.radians(bx - ax) / 2)
    h = up * up + math.cos(math.radians(ay)) * math.cos(math.radians(by)) * across * across
    return 2 * EARTH_RADIUS * math.asin(min(1.0, math.sqrt(h)))


def ruler_scales(latitude: float) -> tuple[float, float]:
    """Metres of a degree of longitude and of latitude on the WGS84 ellipsoid at a latitude."""
    e2 = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
    cosine = math.cos(math.radians(latitude))
    w2 = 1 / (1 - e2 * (1 - cosine * cosine))
    degree = math.radians(1) * WGS84_AXIS * math.sqrt(w2)
    return degree * cosine, degree * w2 * (1 - e2)


def planar(ax: Column, ay: Column, bx: Column, by: Column, sx: float = 1.0, sy: float = 1.0) -> Column:
    dx, dy = (bx - ax) * sx, (by - ay) * sy
    return F.sqrt(dx * dx + dy * dy)


@dataclass(frozen=True)
class Metric:
    """A named distance: ``euclidean``, ``haversine`` or ``cheap-ruler`` (planar metres at a reference latitude)."""

    name: str = "euclidean"
    latitude: float = 0.0

    def __post_init__(self) -> None:
        if self.name not in ("euclidean", "haversine", "cheap-ruler"):
            raise ValueError(f"unknown metric {self.name!r}")

    @property
    def geographic(self) -> bool:
        return self.name != "euclidean"

    def distance(self, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        if self.name == "haversine":
            return haversine(ax, ay, bx, by)
        return planar(ax, ay, bx, by, *(ruler_scales(self.latitude) if self.geographic else (1.0, 1.0)))

    def distance_py(self, ax: float, ay: float, bx: float, by: float) -> float:
        if self.name == "haversine":
            return haversine_py(ax, ay, bx, by)
        sx, sy = ruler_scales(self.latitude) if self.geographic else (1.0, 1.0)
        return math.hypot((bx - ax) * sx, (by - ay) * sy)

    def straight(self, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        """The distance of two positions in the embedding of ``embed_py``: a chord through the globe, or the plane's."""
        if self.name == "haversine":
            return 2 * EARTH_RADIUS * F.sin(haversine(ax, ay, bx, by) / (2 * EARTH_RADIUS))
        return self.distance(ax, ay, bx, by)

    def scales(self, y: Column) -> tuple[Column, Column]:
        """Units of distance for a step in x and in y near latitude y."""
        if self.name == "haversine":
            degree = math.radians(1) * EARTH_RADIUS
            return F.greatest(F.cos(F.radians(y)), F.lit(LEAST_COSINE)) * degree, F.lit(degree)
        sx, sy = ruler_scales(self.latitude) if self.geographic else (1.0, 1.0)
        return F.lit(sx), F.lit(sy)

    def embed_py(self, x: float, y: float) -> tuple[float, ...]:
        """A point of which straight distances never exceed the metric's."""
        if self.name == "haversine":
            lon, lat = math.radians(x), math.radians(y)
            return EARTH_RADIUS * math.cos(lat) * math.cos(lon), EARTH_RADIUS * math.cos(lat) * math.sin(lon), EARTH_RADIUS * math.sin(lat)
        sx, sy = ruler_scales(self.latitude) if self.geographic else (1.0, 1.0)
        return x * sx, y * sy


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, sx: Column, sy: Column) -> Column:
    """Fraction in [0, 1] of segment a-b nearest to p in the local plane; 0 for a segment without length."""
    dx, dy = (bx - ax) * sx, (by - ay) * sy
    square = dx * dx + dy * dy
    t = ((px - ax) * sx * dx + (py - ay) * sy * dy) / F.nullif(square, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def crossing_terms(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column, Column]:
    """The numerators of the fractions along a-b and c-d of their intersection, their denominator, and the size that it is held against."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    return (cx - ax) * sy - (cy - ay) * sx, (cx - ax) * ry - (cy - ay) * rx, rx * sy - ry * sx, (F.abs(rx) + F.abs(ry)) * (F.abs(sx) + F.abs(sy))


def met(p: Column, q: Column, denominator: Column, size: Column) -> tuple[Column, Column]:
    """Both fractions of a crossing by its terms; null where the lines are parallel or do not meet."""
    t, u = (n / F.nullif(denominator, F.lit(0.0)) for n in (p, q))
    meets = (F.abs(denominator) > 1e-14 * size) & t.between(0, 1) & u.between(0, 1)
    return F.when(meets, t), F.when(meets, u)


def side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """'left', 'right' or 'on': where p lies of the digitised direction a-b."""
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return F.when(cross > 0, "left").when(cross < 0, "right").otherwise("on")


def cell(value: Column, size: float | Column) -> Column:
    return F.floor(value / size).cast("long")
