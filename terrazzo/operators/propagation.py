"""Propagation of a line's displacement: over open space with distance, and along a network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrazzo.functions import geometry as G
from terrazzo.plans.durable import discard, materialize
from terrazzo.plans.spatial import within_distance

from .networks import edges_of

_VECTORS = "array<struct<x:double,y:double,dx:double,dy:double>>"


def _along(line, share: np.ndarray) -> np.ndarray:
    p = np.array([(v["x"], v["y"]) for v in line], float)
    far = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    return np.column_stack([np.interp(share * far[-1], far, p[:, k]) for k in (0, 1)])


def interpolate_displacement_vectors(moves: DataFrame, interval: float) -> DataFrame:
    """``(rid, k, x, y, dx, dy)`` of ``moves(rid, before, after)``: what moves points at equal shares of both lengths.

    There are ``floor(length / interval)`` steps, one at least.  A null line, or one under two vertices, gives no rows.
    """

    def run(before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(before, after, strict=True):
            if a is None or b is None or len(a) < 2 or len(b) < 2:
                out.append([])
                continue
            size = sum(np.hypot(q["x"] - p["x"], q["y"] - p["y"]) for p, q in zip(a, a[1:], strict=False))
            share = np.linspace(0, 1, max(1, int(size / interval)) + 1)
            p, q = _along(a, share), _along(b, share)
            out.append([{"x": float(x), "y": float(y), "dx": float(u), "dy": float(v)} for (x, y), (u, v) in zip(p, q - p, strict=True)])
        return pd.Series(out)

    run.__annotations__ = {"before": pd.Series, "after": pd.Series, "return": pd.Series}
    vectors = F.pandas_udf(run, _VECTORS)("before", "after")
    return moves.select("rid", F.posexplode(vectors).alias("k", "v")).select("rid", "k", "v.x", "v.y", "v.dx", "v.dy")


def propagation_crow_flies(lines: DataFrame, move: DataFrame, distance: float, interval: float = 2.0, frozen: DataFrame | None = None) -> DataFrame:
    """``lines(rid, geom)`` with vertices moved along with the one line of ``move(rid, before, after)``.

    A vector acts on vertices up to ``distance`` less the largest displacement away, quadratically less with distance;
    a vertex moves by the mean of the vectors acting on it, weighted by the inverse squared distance (1e12 at none).
    Vertices that coincide, to six decimals, with vertices of ``frozen`` stay.  Vertices meet vectors in grid cells.
    """
    vectors = materialize(interpolate_displacement_vectors(move, interval), "vectors")
    largest = vectors.agg(F.max(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).first()[0]
    reach = distance - (largest or 0.0)
    if largest is None or reach <= 0:
        return lines
    flat = lines.select("rid", F.posexplode("geom").alias("pos", "p")).select(F.struct("rid", "pos").alias("rid"), "p.x", "p.y")
    loose = flat
    if frozen is not None:
        still = frozen.select(F.explode("geom").alias("p")).select(F.round("p.x", 6).alias("fx"), F.round("p.y", 6).alias("fy")).distinct()
        loose = flat.join(still, (F.round("x", 6) == F.col("fx")) & (F.round("y", 6) == F.col("fy")), "left_anti")
    near = within_distance(loose, vectors.select(F.col("k").alias("rid"), "x", "y"), reach)
    near = near.join(vectors.select(F.col("k").alias("r_rid"), "dx", "dy"), "r_rid")
    w = F.when(F.col("d") == 0, 1e12).otherwise(1 / (F.col("d") * F.col("d")))
    fade = 1 - F.pow(F.col("d") / reach, 2)
    moved = near.groupBy(F.col("l_rid.rid").alias("rid"), F.col("l_rid.pos").alias("pos")).agg(
        (F.sum(F.col("dx") * fade * w) / F.sum(w)).alias("mx"), (F.sum(F.col("dy") * fade * w) / F.sum(w)).alias("my")
    )
    by_line = moved.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("mx", "my")))).alias("__moved"))
    shift = lambda p, i: G.point(
        p.x + F.coalesce(F.col("__moved")[i].mx, F.lit(0.0)), p.y + F.coalesce(F.col("__moved")[i].my, F.lit(0.0))
    )
    return lines.join(by_line, "rid", "left").withColumn("geom", F.transform("geom", shift)).drop("__moved")


def propagation_network(lines: DataFrame, move: DataFrame, reach: float | None = None, damping: float = 0.1) -> DataFrame:
    """``lines(rid, geom)`` after the line of ``move(rid, geom)`` took its new shape.

    Breadth first from both its ends: a line's vertices shift by its near end's displacement times a factor that falls
    evenly, vertex by vertex, from 1 to ``damping``, and that the far end hands on.  It falls to 0, and ends there, at
    dangling ends and where the way along lines exceeds ``reach``.  Of several ways of one round to a line, the one
    from the smaller line id counts, then the one from its start.
    """
    ends = edges_of(lines).select("rid", "x1", "y1", "x2", "y2")
    size = lines.select("rid", G.length(F.col("geom")).alias("size"))
    near = ends.select("rid", F.lit(True).alias("at_start"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("node"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("far"))
    near = near.union(ends.select("rid", F.lit(False), F.struct("x2", "y2"), F.struct("x1", "y1")))
    degree = near.groupBy(F.col("node").alias("far")).agg((F.count("*") == 1).alias("dangling"))
    links = materialize(near.join(size, "rid").join(degree, "far").select("rid", "at_start", "node", "far", "size", "dangling"), "links")
    old = lines.join(move.select("rid", F.col("geom").alias("new")), "rid").select("rid", "geom", "new")
    end = lambda c, k: F.element_at(c, k)
    first = old.join(ends, "rid").select("rid", F.explode(F.array(*[
        F.struct(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")).alias("node"), (end("new", k).x - end("geom", k).x).alias("vx"), (end("new", k).y - end("geom", k).y).alias("vy"))
        for i, k in ((1, 1), (2, -1))
    ])).alias("e"))
    front = first.select(F.col("rid").alias("source"), "e.node", "e.vx", "e.vy", F.lit(0.0).alias("way")).where("abs(vx) + abs(vy) > 1e-6")
    done = materialize(move.select("rid", F.lit(None).cast("boolean").alias("at_start"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("last")), "done")
    while True:  # a line is met once
        met = front.join(links, "node").join(done.select("rid"), "rid", "left_anti")
        best = W.partitionBy("rid").orderBy("source", F.desc("at_start"))
        ends_here = F.col("dangling") | (F.col("way") + F.col("size") > F.lit(float("inf") if reach is None else float(reach)))
        met = met.withColumn("k", F.row_number().over(best)).where("k = 1").withColumn("last", F.when(ends_here, 0.0).otherwise(F.lit(damping)))
        met = materialize(met.select("rid", "at_start", "vx", "vy", "last", "far", (F.col("way") + F.col("size")).alias("way")), "met")
        if met.limit(1).count() == 0:
            break
        grown = materialize(done.union(met.select("rid", "at_start", "vx", "vy", "last")), "done")
        discard(done)
        done = grown
        front = met.where("last > 0").select(F.col("rid").alias("source"), F.col("far").alias("node"), (F.col("vx") * F.col("last")).alias("vx"), (F.col("vy") * F.col("last")).alias("vy"), "way")
    out = lines.join(done.select("rid", "at_start", "vx", "vy", "last"), "rid", "left").join(move.select("rid", F.col("geom").alias("__new")), "rid", "left")
    place = lambda i: F.when(F.col("at_start"), i).otherwise(F.size("geom") - 1 - i) / F.greatest(F.lit(1), F.size("geom") - 1)
    factor = lambda i: 1 + (F.col("last") - 1) * place(i)
    shifted = F.transform("geom", lambda p, i: G.point(p.x + F.col("vx") * factor(i), p.y + F.col("vy") * factor(i)))
    geom = F.when(F.col("__new").isNotNull(), F.col("__new")).when(F.col("at_start").isNotNull(), shifted).otherwise(F.col("geom"))
    return out.withColumn("geom", geom).drop("at_start", "vx", "vy", "last", "__new")
