"""Column expressions on ``array<struct<x: double, y: double>>`` (lines; rings when first = last).

All stay in the JVM.  A null line gives null; a line too short for a measure gives 0 or null, as stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_DDL = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"), F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def vertex_count(line: Column) -> Column:
    """Number of vertices."""
    return F.when(line.isNotNull(), F.size(line)).cast("int")


def _steps(line: Column, f) -> Column:
    """Sum of ``f(a, b)`` over successive vertices."""
    n = F.size(line)
    ab = F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), f)
    return F.aggregate(ab, F.lit(0.0), lambda s, x: s + x)


def length(line: Column) -> Column:
    """Length of a line; perimeter of a ring."""
    return _steps(line, lambda a, b: F.hypot(b.x - a.x, b.y - a.y))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for anticlockwise rings; taken from the first vertex, so that digits last far from the origin."""
    p0 = F.get(ring, F.lit(0))
    return _steps(ring, lambda a, b: ((a.x - p0.x) * (b.y - p0.y) - (b.x - p0.x) * (a.y - p0.y)) / 2)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def compactness(ring: Column) -> Column:
    """``4 pi A / P**2``; null for a ring without length."""
    p = length(ring)
    return F.when(p > 0, 4 * F.pi() * area(ring) / (p * p))


def centroid(ring: Column) -> Column:
    """Area centroid of a ring (null without area)."""
    a, p0 = signed_area(ring), F.get(ring, F.lit(0))
    swept = lambda p, q: (p.x - p0.x) * (q.y - p0.y) - (q.x - p0.x) * (p.y - p0.y)
    cx = _steps(ring, lambda p, q: (p.x + q.x - 2 * p0.x) * swept(p, q))
    cy = _steps(ring, lambda p, q: (p.y + q.y - 2 * p0.y) * swept(p, q))
    return F.when(a != 0, F.struct((p0.x + cx / (6 * a)).alias("x"), (p0.y + cy / (6 * a)).alias("y")))


def bbox(line: Column) -> Column:
    """``struct<xmin, ymin, xmax, ymax>``."""
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def segments(line: Column) -> Column:
    """Array of ``struct<x1, y1, x2, y2>``."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))


def angle_2_points(p: Column, q: Column) -> Column:
    """Direction of a segment, in radians."""
    return F.atan2(q.y - p.y, q.x - p.x)


def angle_3_points(p: Column, q: Column, r: Column) -> Column:
    """Difference of the directions from ``q`` to ``r`` and to ``p``, not normalised."""
    return angle_2_points(q, r) - angle_2_points(q, p)


def angle_to_zero_pi(angle: Column) -> Column:
    """Over pi: less pi; then under 0: negated."""
    return F.when(angle > F.pi(), angle - F.pi()).when(angle < 0, -angle).otherwise(angle)


def angle_between_lines(a: Column, b: Column) -> Column:
    """Angle of two lines at the end they share, towards their second next vertices (next, in lines of two vertices).

    Where they share several, a's end goes before its start and b's start before its end; null if none or if a line
    has less than two vertices.
    """
    nth = lambda g, k, front: F.get(g, k if front else F.size(g) - 1 - k)
    away = lambda g, front: nth(g, F.when(F.size(g) > 2, 2).otherwise(1), front)
    end = lambda g, front: nth(g, F.lit(0), front)
    meet, out = F.size(a) > 1, None
    for front_a, front_b in ((False, True), (False, False), (True, False), (True, True)):
        hit, angle = meet & (F.size(b) > 1) & (end(a, front_a) == end(b, front_b)), angle_3_points(away(a, front_a), end(a, front_a), away(b, front_b))
        out = F.when(hit, angle) if out is None else out.when(hit, angle)
    return out


def curvature(p: Column, q: Column, r: Column) -> Column:
    """One over the radius of the circle through three points; null where two coincide."""
    cross = F.abs((q.x - p.x) * (r.y - p.y) - (r.x - p.x) * (q.y - p.y))
    sides = F.hypot(q.x - p.x, q.y - p.y) * F.hypot(r.x - q.x, r.y - q.y) * F.hypot(r.x - p.x, r.y - p.y)
    return F.when(sides > 0, 2 * cross / sides)


def reverse_line(line: Column) -> Column:
    return F.reverse(line)


def merge_lines(a: Column, b: Column) -> Column:
    """Two lines joined at the end they share (null if none): a's end, or its start, meets b's start or end."""
    rest = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    last = lambda x: F.element_at(x, -1)
    return (
        F.when(last(a) == b[0], F.concat(a, rest(b)))
        .when(last(a) == last(b), F.concat(a, rest(F.reverse(b))))
        .when(a[0] == b[0], F.concat(F.reverse(a), rest(b)))
        .when(a[0] == last(b), F.concat(b, rest(a)))
    )


def split_at_vertex(line: Column, p: Column) -> Column:
    """The parts before and after the first vertex equal to ``p`` (both with it); the line alone if it is no inner vertex."""
    at = F.array_position(line, p)
    return F.when((at > 1) & (at < F.size(line)), F.array(F.slice(line, F.lit(1), at.cast("int")), F.slice(line, at.cast("int"), (F.size(line) - at + 1).cast("int")))).otherwise(F.array(line))


def extend_with_point(line: Column, p: Column, position: str = "start") -> Column:
    return F.concat(F.array(p), line) if position == "start" else F.concat(line, F.array(p))


def extend_by_length(line: Column, by: float, position: str = "both") -> Column:
    """Ends moved on along their segments by ``by``."""

    def beyond(a: Column, b: Column) -> Column:
        n = F.hypot(a.x - b.x, a.y - b.y)
        return F.struct((a.x + (a.x - b.x) / n * by).alias("x"), (a.y + (a.y - b.y) / n * by).alias("y"))

    out = line
    if position in ("start", "both"):
        out = F.concat(F.array(beyond(line[0], line[1])), out)
    if position in ("end", "both"):
        out = F.concat(out, F.array(beyond(F.element_at(line, -1), F.element_at(line, -2))))
    return out


def point_at(line: Column, at: Column) -> Column:
    """The point ``at`` along a line, its ends beyond them; null for an empty line."""
    zero = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("struct<x:double,y:double>").alias("p"))

    def step(s: Column, e: Column) -> Column:
        n = F.hypot(e.x2 - e.x1, e.y2 - e.y1)
        t = F.try_divide(at - s.done, n)
        here = F.when(s.p.isNull() & (n > 0) & (s.done + n >= at), point(e.x1 + (e.x2 - e.x1) * F.greatest(t, F.lit(0.0)), e.y1 + (e.y2 - e.y1) * F.greatest(t, F.lit(0.0)))).otherwise(s.p)
        return F.struct((s.done + n).alias("done"), here.alias("p"))

    return F.coalesce(F.aggregate(segments(line), zero, step).p, F.get(line, F.size(line) - 1))


def middle_point(line: Column) -> Column:
    """The point at half a line's length."""
    return point_at(line, length(line) / 2)


def distance_to_line(p: Column, line: Column) -> Column:
    """Distance of a point to the nearest place of a line; null for a line of less than two vertices."""

    def one(s: Column) -> Column:
        dx, dy = s.x2 - s.x1, s.y2 - s.y1
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((p.x - s.x1) * dx + (p.y - s.y1) * dy, n)))).otherwise(0.0)
        return F.hypot(p.x - s.x1 - t * dx, p.y - s.y1 - t * dy)

    return F.array_min(F.transform(segments(line), one))


def hausdorff(a: Column, b: Column) -> Column:
    """Largest distance of a vertex of either line to the other line."""
    far = lambda g, h: F.array_max(F.transform(g, lambda p: distance_to_line(p, h)))
    return F.greatest(far(a, b), far(b, a))


def shortest_edge(line: Column) -> Column:
    return F.array_min(F.transform(segments(line), lambda s: F.hypot(s.x2 - s.x1, s.y2 - s.y1)))


def is_ccw(ring: Column) -> Column:
    return signed_area(ring) > 0


def is_closed(line: Column) -> Column:
    return (F.size(line) > 1) & (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1))


def to_2d(line: Column) -> Column:
    """A line of ``struct<x, y, z>`` without z."""
    return F.transform(line, lambda p: point(p.x, p.y))


def bend_side(line: Column) -> Column:
    """``left`` or ``right``: the sign of the doubled area swept from the first vertex."""
    p0 = line[0]
    swept = _steps(line, lambda a, b: (a.x - p0.x) * (b.y - p0.y) - (b.x - p0.x) * (a.y - p0.y))
    return F.when(swept < 0, "right").otherwise("left")


def whirlpool(line: Column, threshold: float) -> Column:
    """Keeps vertices at least ``threshold`` from the last kept one, and the last vertex."""
    far = lambda a, p: F.hypot(F.element_at(a, -1).x - p.x, F.element_at(a, -1).y - p.y) >= threshold
    kept = F.aggregate(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 1, 1), lambda a, p: F.when(far(a, p), F.concat(a, F.array(p))).otherwise(a))
    return F.when(F.element_at(kept, -1) == F.element_at(line, -1), kept).otherwise(F.concat(kept, F.slice(line, -1, 1)))


def moving_average(line: Column, weights: tuple[float, float, float] = (1.0, 2.0, 1.0), iterations: int = 1) -> Column:
    """Three-point weighted moving average of an open line; its ends stay."""
    a, b, c = (w / sum(weights) for w in weights)
    def smooth(o: Column) -> Column:
        n = F.size(o)
        blend = lambda i, k: a * F.element_at(o, i - 1)[k] + b * F.element_at(o, i)[k] + c * F.element_at(o, i + 1)[k]
        mid = F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.struct(*[blend(i, k).alias(k) for k in "xy"]))
        return F.when(n < 3, o).otherwise(F.concat(F.slice(o, 1, 1), mid, F.slice(o, -1, 1)))

    out = line
    for _ in range(iterations):
        out = smooth(out)
    return out


def chaikin(line: Column, iterations: int = 1) -> Column:
    """Corner cutting of an open line with its ends kept."""
    out = line
    for _ in range(iterations):
        n = F.size(out)
        cut = F.flatten(F.transform(segments(out), lambda s: F.array(
            F.struct((s.x1 * 0.75 + s.x2 * 0.25).alias("x"), (s.y1 * 0.75 + s.y2 * 0.25).alias("y")),
            F.struct((s.x1 * 0.25 + s.x2 * 0.75).alias("x"), (s.y1 * 0.25 + s.y2 * 0.75).alias("y")),
        )))
        out = F.when(n < 3, out).otherwise(F.concat(F.slice(out, 1, 1), F.slice(cut, F.lit(2), F.size(cut) - 2), F.slice(out, -1, 1)))
    return out


def to_wkt(line: Column, kind: str = "LINESTRING") -> Column:
    """WKT of a line or (``kind='POLYGON'``) of a ring."""
    body = F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", ")
    return F.concat(F.lit(kind + " (("), body, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(kind + " ("), body, F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Vertices of a LINESTRING or of a POLYGON's shell."""
    first = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    return F.transform(F.split(F.trim(first), r"\s*,\s*"), lambda s: F.struct(F.split(s, r"\s+")[0].cast("double").alias("x"), F.split(s, r"\s+")[1].cast("double").alias("y")))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring holds a point (even-odd rule; points on the boundary are undefined)."""
    hits = _steps(ring, lambda a, b: F.when((a.y > y) != (b.y > y), F.when(x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x, 1.0).otherwise(0.0)).otherwise(0.0))
    return hits % 2 == 1


def covers_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a ring or on it."""
    return contains_point(ring, x, y) | (distance_to_line(point(x, y), ring) == 0)


def circle_arc(a: Column, b: Column, c: Column, rotation: str = "cw", quad_segs: int = 8) -> Column:
    """Vertices from ``b`` to ``c`` around ``a``, both included: ``floor(angle / (pi / 2) * quad_segs) + 2`` of them.

    The radius is that of ``b``.  Null where ``b`` and ``c`` aren't at one distance (to 1e-6 of it) from ``a``.
    """
    r, r2 = F.hypot(b.x - a.x, b.y - a.y), F.hypot(c.x - a.x, c.y - a.y)
    start, end = F.atan2(b.y - a.y, b.x - a.x), F.atan2(c.y - a.y, c.x - a.x)
    sign = -1.0 if rotation == "cw" else 1.0
    turn = F.pmod((end - start) * sign, 2 * F.pi())
    n = F.floor(turn / (F.pi() / 2) * quad_segs).cast("int") + 2
    at = lambda k: start + sign * turn * k / (n - 1)
    inner = F.transform(F.sequence(F.lit(0), n - 1), lambda k: point(a.x + r * F.cos(at(k)), a.y + r * F.sin(at(k))))
    inner = F.concat(F.array(point(b.x, b.y)), F.slice(inner, F.lit(2), n - 2), F.array(point(c.x, c.y)))
    return F.when(F.abs(r - r2) <= r * 1e-6, inner)
