"""Coordinates: projections in closed form and measures of rings, as Column expressions.

A geometry is an array of rings (ring 0 the shell, others holes), a ring an array of structs (x, y), closed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY = "array<array<struct<x:double,y:double>>>"

#: Fixed values of the projections: sphere of EPSG:3410; axis and flattening of WGS84; parallels and origin of the Albers grid.
SPHERE = 6_371_228.0
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
ALBERS = (43.0, 62.0, 30.0, -30.0)
E2 = FLATTENING * (2 - FLATTENING)
E1 = math.sqrt(E2)


def points(geom: Column, fx: Callable, fy: Callable) -> Column:
    """geom with both coordinates of every point made anew from (x, y)."""
    return F.transform(geom, lambda ring: F.transform(ring, lambda p: F.struct(fx(p.x, p.y).alias("x"), fy(p.x, p.y).alias("y"))))


def to_ease_grid(geom: Column) -> Column:
    """EPSG:4326 to 3410: spherical cylindrical equal area, true at 30 degrees."""
    k = math.cos(math.radians(30))
    return points(geom, lambda x, y: F.radians(x) * (SPHERE * k), lambda x, y: F.sin(F.radians(y)) * (SPHERE / k))


def from_ease_grid(geom: Column) -> Column:
    k = math.cos(math.radians(30))
    return points(geom, lambda x, y: F.degrees(x / (SPHERE * k)), lambda x, y: F.degrees(F.asin(y * k / SPHERE)))


def _q(sin: Column) -> Column:
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - F.log((1 - E1 * sin) / (1 + E1 * sin)) / (2 * E1))


def q_of(degrees: float) -> float:
    s = math.sin(math.radians(degrees))
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def to_ease2(geom: Column) -> Column:
    """EPSG:4326 to 6933: cylindrical equal area on the WGS84 ellipsoid, true at 30 degrees."""
    s = math.sin(math.radians(30))
    k = math.cos(math.radians(30)) / math.sqrt(1 - E2 * s * s)
    return points(geom, lambda x, y: F.radians(x) * (AXIS * k), lambda x, y: _q(F.sin(F.radians(y))) * (AXIS / (2 * k)))


def _albers() -> tuple[float, float, float]:
    p1, p2, p0, _ = ALBERS
    m = [math.cos(math.radians(p)) / math.sqrt(1 - E2 * math.sin(math.radians(p)) ** 2) for p in (p1, p2)]
    n = (m[0] ** 2 - m[1] ** 2) / (q_of(p2) - q_of(p1))
    c = m[0] ** 2 + n * q_of(p1)
    return n, c, AXIS * math.sqrt(c - n * q_of(p0)) / n


def to_albers(geom: Column) -> Column:
    """EPSG:4326 to the Albers equal-area grid of the impact model."""
    n, c, rho0 = _albers()
    rho = lambda y: F.sqrt(c - n * _q(F.sin(F.radians(y)))) * (AXIS / n)
    theta = lambda x: F.radians(x - ALBERS[3]) * n
    return points(geom, lambda x, y: rho(y) * F.sin(theta(x)), lambda x, y: rho0 - rho(y) * F.cos(theta(x)))


def albers_inverse(x: Column | str, y: Column | str) -> Column:
    """Struct of longitude and latitude of Albers coordinates."""
    return F.pandas_udf(_albers_inverse, "x double, y double")(x, y)


def _albers_inverse(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """The latitude comes by a few Newton steps."""
    n, c, rho0 = _albers()
    x, y = x.to_numpy(float), rho0 - y.to_numpy(float)
    q = (c - (np.hypot(x, y) * n / AXIS) ** 2) / n
    phi = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(6):
        s = np.sin(phi)
        f = q / (1 - E2) - s / (1 - E2 * s * s) + np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)
        phi = phi + (1 - E2 * s * s) ** 2 / (2 * np.cos(phi)) * f
    return pd.DataFrame({"x": ALBERS[3] + np.degrees(np.arctan2(x, y) / n), "y": np.degrees(phi)})


def forward(name: str, x: Column, y: Column) -> Column:
    """Struct (x, y) of longitude and latitude in EPSG:4326, EPSG:3410, EPSG:6933 or the impact model's albers."""
    one = F.array(F.array(F.struct(x.alias("x"), y.alias("y"))))
    made = {"EPSG:4326": lambda g: g, "EPSG:3410": to_ease_grid, "EPSG:6933": to_ease2, "albers": to_albers}[name](one)
    return made[0][0]


def inverse(name: str, x: Column, y: Column) -> Column:
    """Struct (x, y) of longitude and latitude from coordinates in EPSG:4326, EPSG:3410 or albers."""
    if name == "albers":
        return albers_inverse(x, y)
    one = F.array(F.array(F.struct(x.alias("x"), y.alias("y"))))
    return {"EPSG:4326": lambda g: g, "EPSG:3410": from_ease_grid}[name](one)[0][0]


def box_geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """An axis-aligned rectangle, anticlockwise."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)))


def ring_sum(ring: Column, term: Callable) -> Column:
    """Sum of term(a, b) over the edges a to b."""
    edges = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), term)
    return F.aggregate(edges, F.lit(0.0), lambda s, v: s + v)


def planar_area(geom: Column) -> Column:
    """Shoelace area of the shell less that of the holes."""
    each = F.transform(geom, lambda ring: F.abs(ring_sum(ring, lambda a, b: a.x * b.y - b.x * a.y)) / 2)
    return F.aggregate(F.transform(each, lambda a, i: F.when(i == 0, a).otherwise(-a)), F.lit(0.0), lambda s, v: s + v)


def perimeter(geom: Column) -> Column:
    return F.aggregate(F.transform(geom, lambda ring: ring_sum(ring, lambda a, b: F.hypot(b.x - a.x, b.y - a.y))), F.lit(0.0), lambda s, v: s + v)


def bbox(geom: Column) -> Column:
    """Struct (x0, y0, x1, y1)."""
    flat = F.flatten(geom)
    xs, ys = F.transform(flat, lambda p: p.x), F.transform(flat, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def envelope_agg(df: DataFrame, geom: str, by: list[str]) -> DataFrame:
    """The box around all geometries of each group."""
    b = df.select(*by, bbox(F.col(geom)).alias("b"))
    return b.groupBy(*by).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def centroid(geom: Column) -> Column:
    """Area centroid of the shell, as struct (x, y); the first point where it has no area."""
    ring = geom[0]
    cross = lambda a, b: a.x * b.y - b.x * a.y
    area = ring_sum(ring, cross)
    x = ring_sum(ring, lambda a, b: (a.x + b.x) * cross(a, b)) / (3 * area)
    y = ring_sum(ring, lambda a, b: (a.y + b.y) * cross(a, b)) / (3 * area)
    return F.when(area != 0, F.struct(x.alias("x"), y.alias("y"))).otherwise(ring[0])


def polygon_from_points(df: DataFrame, key: str) -> DataFrame:
    """(key, geometry) of closed lines drawn as points (key, seq, x, y) with four points at least; others are left out."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    lines = df.groupBy(key).agg(ring.alias("ring"))
    closed = (F.size("ring") >= 4) & (F.element_at("ring", 1) == F.element_at("ring", -1))
    return lines.where(closed).select(key, F.array("ring").alias("geometry"))


def geom_kind(df: DataFrame, kind: str, order: str) -> DataFrame:
    """One row: Point if the first geometry's type contains Point, else Polygon."""
    first = df.agg(F.min_by(kind, order).alias("first"))
    return first.select(F.when(F.col("first").contains("Point"), "Point").otherwise("Polygon").alias("kind"))
