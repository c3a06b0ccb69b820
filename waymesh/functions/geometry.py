"""Plane geometry as Column expressions: no UDF, so all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres of the local tangent plane.
EARTH_M = 6_371_000.0
#: Squared length below which a segment is a point.
DEGENERATE = 1e-18


def let(value: Column, f) -> Column:
    """f(value), computed once and with one copy of its expression in the plan, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def lonlat_to_metres(lon: Column, lat: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north metres of the plane that touches the earth at the origin."""
    return F.radians(lon - lon0) * (EARTH_M * math.cos(math.radians(lat0))), F.radians(lat - lat0) * EARTH_M


def metres_to_lonlat(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    return F.lit(lon0) + F.degrees(x / (EARTH_M * math.cos(math.radians(lat0)))), F.lit(lat0) + F.degrees(y / EARTH_M)


def position_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where along a segment a point projects to, from 0 to 1; 0 on a degenerate one."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    at = ((px - ax) * dx + (py - ay) * dy) / F.when(square < DEGENERATE, 1.0).otherwise(square)
    return F.when(square < DEGENERATE, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)))


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Positions on both segments of their crossing, null unless it is strictly inside both."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = rx * sy - ry * sx
    safe = F.when(F.abs(det) < 1e-12, None).otherwise(det)
    t = ((cx - ax) * sy - (cy - ay) * sx) / safe
    u = ((cx - ax) * ry - (cy - ay) * rx) / safe
    inside = (t > 1e-9) & (t < 1 - 1e-9) & (u > 1e-9) & (u < 1 - 1e-9)
    return F.when(inside, t), F.when(inside, u)


def polyline_length(line: str | Column) -> Column:
    """Length of an array of structs x, y."""
    line = F.col(line) if isinstance(line, str) else line
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def turn(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Signed angle in radians from direction u to direction v, left turns positive."""
    return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)


def heading_change(before_deg: Column, after_deg: Column) -> Column:
    """Signed change of heading, above -180 and up to 180 degrees."""
    return 180.0 - F.pmod(180.0 - (after_deg - before_deg), F.lit(360.0))
