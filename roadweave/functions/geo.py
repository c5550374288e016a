"""Geometry on columns: points are STRUCT<lat, lon>, polylines arrays of points. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_M

POINT = "struct<lat: double, lon: double>"
LINE = f"array<{POINT}>"


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def snap(lat: Column, lon: Column, digits: int = 6) -> Column:
    """A point rounded to ``digits`` decimals, so that equal places are equal values."""
    return point(F.round(lat, digits), F.round(lon, digits))


def key(p: Column, digits: int = 6) -> Column:
    """Integer form of a snapped point for equality joins."""
    return F.struct(*(F.round(p[c] * 10**digits).cast("long").alias(c) for c in ("lat", "lon")))


def haversine(a: Column, b: Column) -> Column:
    """Great-circle distance in metres."""
    la, lb = F.radians(a["lat"]), F.radians(b["lat"])
    s = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((F.radians(b["lon"]) - F.radians(a["lon"])) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(s))


def bearing(a: Column, b: Column) -> Column:
    """Initial bearing from a to b in [0, 2 pi)."""
    la, lb = F.radians(a["lat"]), F.radians(b["lat"])
    d = F.radians(b["lon"]) - F.radians(a["lon"])
    y, x = F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d)
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi))


def hops(line: Column) -> Column:
    """Array of (from, to) structs of neighbouring points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def path_length(line: Column) -> Column:
    """Sum of the hops in metres; 0 for fewer than two points."""
    return F.aggregate(hops(line), F.lit(0.0), lambda total, h: total + haversine(h["a"], h["b"]))


def collapse_repeats(line: Column) -> Column:
    """The polyline without points equal to the one before."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.get(line, i - 1)))


def centroid(line: Column) -> Column:
    """Unweighted mean of the vertices."""
    total = lambda c: F.aggregate(line, F.lit(0.0), lambda t, p: t + p[c])
    return F.struct(*((total(c) / F.size(line)).alias(c) for c in ("lat", "lon")))


def middle(line: Column) -> Column:
    """The vertex at index size div 2."""
    return F.element_at(line, (F.floor(F.size(line) / 2) + 1).cast("int"))


def cell(value: Column, size: float) -> Column:
    """Grid cell by truncation toward zero (the cells around zero are twice as wide)."""
    return (value / F.lit(size)).cast("long")


def around(p: Column, size: float) -> Column:
    """The 3 x 3 cells around a point's cell as an array of (cx, cy, rank), in row order."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(3 * (dx + 1) + dy + 1).alias("rank")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return F.transform(offsets, lambda o: F.struct((cell(p["lat"], size) + o["dx"]).alias("cx"), (cell(p["lon"], size) + o["dy"]).alias("cy"), o["rank"].alias("rank")))


def drive_seconds(metres: Column, kmh: Column) -> Column:
    return metres / (kmh * 1000.0 / 3600.0)
