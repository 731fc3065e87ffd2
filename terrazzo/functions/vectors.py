"""Plane vectors and points as Column expressions on ``struct<x: double, y: double>``; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrazzo.functions.geometry import point


def between(p: Column, q: Column) -> Column:
    """The vector from ``p`` to ``q``."""
    return point(q.x - p.x, q.y - p.y)


def from_angle(angle: Column, norm: Column) -> Column:
    return point(norm * F.cos(angle), norm * F.sin(angle))


def add(u: Column, v: Column) -> Column:
    """Sum of two vectors; a point moved by a vector."""
    return point(u.x + v.x, u.y + v.y)


def scale(u: Column, by: Column) -> Column:
    return point(u.x * by, u.y * by)


def opposite(u: Column) -> Column:
    return point(-u.x, -u.y)


def dot(u: Column, v: Column) -> Column:
    return u.x * v.x + u.y * v.y


def cross(u: Column, v: Column) -> Column:
    return u.x * v.y - u.y * v.x


def norm(u: Column) -> Column:
    return F.hypot(u.x, u.y)


def direction(u: Column) -> Column:
    return F.atan2(u.y, u.x)


def with_norm(u: Column, to: Column) -> Column:
    """The vector drawn out to norm ``to``; null for a vector without length."""
    n = norm(u)
    return F.when(n > 0, point(F.try_divide(u.x, n) * to, F.try_divide(u.y, n) * to))


def angle(u: Column, v: Column) -> Column:
    """Unsigned angle of two vectors, 0 where one has no length."""
    n = norm(u) * norm(v)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(u, v), n))))).otherwise(0.0)


def project(u: Column, angle: Column) -> Column:
    """The part of ``u`` in direction ``angle``."""
    unit = from_angle(angle, F.lit(1.0))
    return scale(unit, dot(u, unit))


def rotate(u: Column, angle: Column) -> Column:
    """``u`` turned anticlockwise."""
    return point(u.x * F.cos(angle) - u.y * F.sin(angle), u.x * F.sin(angle) + u.y * F.cos(angle))
