"""Spatial joins on grid bins: equi-joins on cell ids, so that no pair outside neighbouring cells is ever formed.

Sides are never broadcast: Spark takes a table's few bytes for its size, not the rows and geometries made from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .durable import discard, materialize


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def _around(c: Column, reach: int = 1) -> Column:
    return F.explode(F.sequence(c - reach, c + reach))


def within_distance(left: DataFrame, right: DataFrame, distance: float) -> DataFrame:
    """``(l_rid, r_rid, d)`` for points ``(rid, x, y)`` at most ``distance`` apart.

    Right points are put in the nine cells around theirs; a pair meets in the left point's cell only.  A cell of very
    many points is split by AQE's skew join, whose sides both stay distributed.
    """
    a = left.select(F.col("rid").alias("l_rid"), F.col("x").alias("lx"), F.col("y").alias("ly"), cell_of(F.col("x"), distance).alias("cx"), cell_of(F.col("y"), distance).alias("cy"))
    b = right.select(F.col("rid").alias("r_rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), _around(cell_of(F.col("x"), distance)).alias("cx"), cell_of(F.col("y"), distance).alias("c"))
    b = b.select("r_rid", "rx", "ry", "cx", _around(F.col("c")).alias("cy"))
    d = F.sqrt((F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")) + (F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")))
    return a.join(b.hint("merge"), ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= distance).select("l_rid", "r_rid", "d")


def self_pairs(points: DataFrame, distance: float) -> DataFrame:
    """``(l_rid, r_rid, d)`` with ``l_rid < r_rid``."""
    return within_distance(points, points, distance).where("l_rid < r_rid")


def dense_reach(points: DataFrame, cell: float, crowd: float = 16.0) -> float:
    """``cell``, halved until a point shares its cell with at most ``crowd`` on average, itself counted."""
    reach, was = float(cell), float("inf")
    for _ in range(40):
        n = points.groupBy(cell_of(F.col("x"), reach), cell_of(F.col("y"), reach)).agg(F.count("*").cast("double").alias("n"))
        shared = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if shared <= crowd or (shared <= 16 * crowd and shared > 0.9 * was):
            break
        reach, was = reach / 2, shared
    return reach


def nearest(left: DataFrame, right: DataFrame, k: int, cell: float, exclude_self: bool = False) -> DataFrame:
    """``(l_rid, rank, r_rid, d)``: the ``k`` nearest right points of each left point; ties to the smaller ``r_rid``.

    Rings of cells are searched by doubling reach, from ``cell`` or less where points are dense, until every left point
    has ``k`` points nearer than the reach or the reach spans the extent.  Only unfinished points go on.  Of right
    points at one place only as many as can be asked for are compared.
    """
    ext = left.select("x", "y").union(right.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    span = max(float(ext[0] or 0), float(ext[1] or 0), float(cell))
    place = F.row_number().over(W.partitionBy("x", "y").orderBy("rid"))
    right = materialize(right.select("rid", "x", "y").withColumn("n", place).where(F.col("n") <= k + int(exclude_self)).drop("n"), "right")
    todo, reach, done = left.select("rid", "x", "y"), dense_reach(right, cell), None
    while True:
        # the unfinished are put in the nine cells around theirs, as they soon are few
        found = within_distance(right, todo, reach).select(F.col("r_rid").alias("l_rid"), F.col("l_rid").alias("r_rid"), "d")
        if exclude_self:
            found = found.where("l_rid <> r_rid")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("l_rid").orderBy("d", "r_rid"))).where(F.col("rank") <= k)
        ranked = materialize(ranked.select("l_rid", "rank", "r_rid", "d"), "ranked")
        last = reach > 1.5 * span
        full = ranked.where(F.col("rank") == k).select("l_rid")
        part = ranked if last else ranked.join(full, "l_rid", "left_semi")
        done = part if done is None else done.union(part)
        if last:
            return done
        rest = materialize(todo.join(full, todo.rid == full.l_rid, "left_anti"), "todo")
        discard(todo)
        todo = rest
        if todo.limit(1).count() == 0:
            return done
        reach *= 2


def boxes_intersect(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """``(l_rid, r_rid)`` of boxes ``(rid, xmin, ymin, xmax, ymax)`` that meet; each pair is kept by the cell of its common lower corner."""

    def binned(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*[F.col(c).alias(p + c) for c in ("rid", "xmin", "ymin", "xmax", "ymax")])
        out = out.withColumn("cx", F.explode(F.sequence(cell_of(F.col(p + "xmin"), cell), cell_of(F.col(p + "xmax"), cell))))
        return out.withColumn("cy", F.explode(F.sequence(cell_of(F.col(p + "ymin"), cell), cell_of(F.col(p + "ymax"), cell))))

    met = binned(left, "l_").join(binned(right, "r_").hint("merge"), ["cx", "cy"]).where("l_xmin <= r_xmax and r_xmin <= l_xmax and l_ymin <= r_ymax and r_ymin <= l_ymax")
    own = (F.col("cx") == cell_of(F.greatest("l_xmin", "r_xmin"), cell)) & (F.col("cy") == cell_of(F.greatest("l_ymin", "r_ymin"), cell))
    return met.where(own).select("l_rid", "r_rid")


def group_intersecting(boxes: DataFrame, cell: float) -> DataFrame:
    """``(node, component)``: groups of boxes that meet, directly or through others."""
    from .components import connected_components

    pairs = boxes_intersect(boxes, boxes, cell).where("l_rid <= r_rid")
    return connected_components(pairs, "l_rid", "r_rid")


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float, edges: bool = False) -> DataFrame:
    """``(rid, ring_id)`` of points ``(rid, x, y)`` in rings ``(ring_id, ring)``; with ``edges`` also of those on them."""
    from terrazzo.functions import geometry as G

    box = rings.withColumn("b", G.bbox(F.col("ring")))
    box = box.withColumn("cx", F.explode(F.sequence(cell_of(F.col("b.xmin"), cell), cell_of(F.col("b.xmax"), cell))))
    box = box.withColumn("cy", F.explode(F.sequence(cell_of(F.col("b.ymin"), cell), cell_of(F.col("b.ymax"), cell))))
    p = points.select("rid", "x", "y", cell_of(F.col("x"), cell).alias("cx"), cell_of(F.col("y"), cell).alias("cy"))
    met = p.join(box.hint("merge"), ["cx", "cy"]).where("x >= b.xmin and x <= b.xmax and y >= b.ymin and y <= b.ymax")
    return met.where((G.covers_point if edges else G.contains_point)(F.col("ring"), F.col("x"), F.col("y"))).select("rid", "ring_id")
