"""Closed-form transformations between longitude and latitude and web mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
_DEGREES = ("EPSG:4326",)
_MERCATOR = ("EPSG:3857", "EPSG:900913")


def transform(source: str, target: str, x: float, y: float) -> tuple[float, float]:
    s, t = source.upper(), target.upper()
    if s == t:
        return x, y
    if s in _DEGREES and t in _MERCATOR:
        return math.radians(x) * RADIUS, RADIUS * math.log(math.tan(math.pi / 4 + math.radians(y) / 2))
    if s in _MERCATOR and t in _DEGREES:
        return math.degrees(x / RADIUS), math.degrees(2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2)
    raise ValueError(f"no transformation from {source} to {target}")


def transform_columns(source: str, target: str, x: Column, y: Column) -> tuple[Column, Column]:
    s, t = source.upper(), target.upper()
    if s == t:
        return x, y
    if s in _DEGREES and t in _MERCATOR:
        return F.radians(x) * RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * RADIUS
    if s in _MERCATOR and t in _DEGREES:
        return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - F.lit(math.pi / 2))
    raise ValueError(f"no transformation from {source} to {target}")
