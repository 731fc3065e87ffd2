"""Tessellations and partitions of space."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.plans.durable import discard, materialize

from .points import extent, quadtree_cells

#: Levels that an index of a quadtree holds, and levels a round.
DEEP, STEP = 62, 8


def _ring(*xy: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in [*xy, xy[0]]])


def tessellate(spark: SparkSession, bounds: tuple[float, float, float, float], width: float, height: float | None = None, shape: str = "square") -> DataFrame:
    """``(cell, geom)``: cells over ``bounds`` in column-major order, generated in parallel.

    Square cells of ``width`` by ``height``; hexagons (flat side ``width``, twice as high) in two interleaved
    lattices; diamonds with diagonals of ``width``.
    """
    x0, y0, x1, y1 = bounds
    h = width if height is None else height
    w = F.lit(float(width))

    def lattice(ax: float, ay: float, nx: int, ny: int, sx: float, sy: float) -> DataFrame:
        ids = spark.range(max(0, nx) * max(0, ny)).select(F.expr(f"id div {max(1, ny)}").alias("i"), (F.col("id") % max(1, ny)).alias("j"))
        return ids.select("i", "j", (F.lit(float(ax)) + F.col("i") * sx).alias("x"), (F.lit(float(ay)) + F.col("j") * sy).alias("y"))

    x, y = F.col("x"), F.col("y")
    if shape == "square":
        nx, ny = math.ceil((x1 - x0) / width), math.ceil((y1 - y0) / h)
        c = lattice(x0, y0, nx, ny, width, h)
        return c.select((F.col("i") * max(1, ny) + F.col("j")).alias("cell"), _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h)).alias("geom"))
    if shape == "diamond":
        nx, ny = math.ceil((x1 - x0) / width) + 1, math.ceil((y1 - y0) / width) + 1
        c = lattice(x0, y0 - width, nx, ny, width, width)
        return c.select((F.col("i") * ny + F.col("j")).alias("cell"), _ring((x, y), (x + w / 2, y + w / 2), (x, y + w), (x - w / 2, y + w / 2)).alias("geom"))
    if shape == "hexagonal":
        out, at = None, 0
        for ax, ay, bx, by in ((x0 - width, y0 - width, x1 + width, y1), (x0 + width / 2, y0 - 2 * width, x1 + width, y1 + width)):
            nx, ny = math.ceil((bx - ax) / (3 * width)), math.ceil((by - ay) / (2 * width))
            c = lattice(ax, ay, nx, ny, 3 * width, 2 * width)
            hexagon = _ring((x, y), (x + w, y), (x + w * 1.5, y + w), (x + w, y + 2 * w), (x, y + 2 * w), (x - w / 2, y + w))
            part = c.select((F.col("i") * max(1, ny) + F.col("j") + at).alias("cell"), hexagon.alias("geom"))
            out, at = part if out is None else out.union(part), at + max(0, nx) * max(0, ny)
        return out
    raise ValueError(f"unknown shape {shape!r}")


def partition_grid(points: DataFrame, width: float, height: float | None = None) -> DataFrame:
    """``(rid, part_id)``: the first square cell, in column-major order, that holds each representative point."""
    e = extent(points)
    if e.xmin is None:
        return points.select("rid", F.lit(None).cast("long").alias("part_id")).limit(0)
    h = width if height is None else height
    ny = max(1, math.ceil((e.ymax - e.ymin) / h))
    # a point on an edge falls to the earlier cell
    index = lambda v, lo, size: F.greatest(F.lit(0), F.ceil((F.col(v) - F.lit(float(lo))) / F.lit(float(size))) - 1).cast("long")
    return points.select("rid", (index("x", e.xmin, width) * ny + index("y", e.ymin, h)).alias("part_id"))


def partition_quadtree(points: DataFrame, max_depth: int | None = None, max_points: int = 1) -> DataFrame:
    """``(rid, level, qi, qj)``: the quadtree leaf of each point; every point is in one leaf.

    A cell is split while it holds more than ``max_points``.  Without ``max_depth`` there is no limit: cells that hold
    nothing but points at one place are leaves, and points that only levels beyond 62 would part raise.  With it,
    leaves have levels of 1 to ``max_depth``.  Points on a dividing line go up and right.
    """
    if max_depth is not None and max_points == 1:
        return quadtree_cells(points, max_depth).select("rid", "level", "qi", "qj")
    e = extent(points)
    if e.xmin is None:
        return points.select("rid", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("qi"), F.lit(None).cast("long").alias("qj")).limit(0)
    side = max(e.xmax - e.xmin, e.ymax - e.ymin) or 1.0
    x0, y0 = (e.xmin + e.xmax - side) / 2, (e.ymin + e.ymax - side) / 2
    # scaling by a power of two is exact, so a cell at level d is the index shifted by DEEP - d
    share = lambda v, v0: (F.col(v) - F.lit(float(v0))) / F.lit(float(side))
    index = lambda u: F.greatest(F.lit(0), F.least(F.lit((1 << DEEP) - 1), F.floor(u * float(1 << DEEP)))).cast("long")
    placed = materialize(points.select("rid", share("x", x0).alias("u"), share("y", y0).alias("v")).withColumn("i", index(F.col("u"))).withColumn("j", index(F.col("v"))), "placed")
    todo = places = materialize(placed.groupBy("i", "j").agg(F.count("*").alias("n"), (F.countDistinct("u", "v") > 1).alias("many")), "places")
    if places.where(F.col("many") & (F.col("n") > max_points)).limit(1).count() and max_depth is None:
        raise ValueError(f"points are closer than 2 ** -{DEEP} of the square's side")
    first, last, out = 0 if max_depth is None else 1, DEEP if max_depth is None else max_depth, []
    while first <= last:
        top = min(last, first + STEP - 1)
        at = todo.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(top))))
        at = at.withColumn("qi", F.expr(f"shiftright(i, {DEEP} - level)")).withColumn("qj", F.expr(f"shiftright(j, {DEEP} - level)"))
        whole = F.sum("n") <= max_points if max_depth is not None else (F.sum("n") <= max_points) | (F.count("*") == 1)
        leaf = at.groupBy("level", "qi", "qj").agg((whole | F.lit(max_depth is not None and top == last) & (F.col("level") == last)).alias("leaf")).where("leaf").drop("leaf")
        found = materialize(at.join(leaf, ["level", "qi", "qj"]).groupBy("i", "j").agg(F.min("level").alias("level")), "leaves")
        out.append(found)
        rest = materialize(todo.join(found, ["i", "j"], "left_anti"), "places")
        if todo is not places:
            discard(todo)
        todo, first = rest, top + 1
        if todo.limit(1).count() == 0:
            break
    level = functools.reduce(DataFrame.union, out)
    return placed.join(level, ["i", "j"]).select("rid", "level", F.expr(f"shiftright(i, {DEEP} - level)").alias("qi"), F.expr(f"shiftright(j, {DEEP} - level)").alias("qj"))
