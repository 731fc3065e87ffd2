"""Point reduction and density: label grid, k-means, quadtree, heatmap.

Each reduction comes as *selection* and *simplification* (all input rows with flags) and *aggregation* (a row a group).
Ties go to the smaller ``rid``.  Empty tables give empty results with their schema.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from terrazzo.plans.durable import broadcast_if_small, discard, materialize


def extent(points: DataFrame):
    """``xmin, ymin, xmax, ymax`` as one row."""
    return points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")).first()


# --- label grid ----------------------------------------------------------------------------------------------------


def grid_cells(points: DataFrame, width: float, height: float | None = None, shape: str = "square") -> DataFrame:
    """``points`` with ``ci, cj, cx, cy``: the indices and centre of each cell that holds or touches a point.

    A point on an edge belongs to every cell at that edge (as many rows).  Square cells start at the extent's lower
    left corner; hexagons are ``2 * width`` high with flat sides of ``width``; diamonds have diagonals of ``width``.
    """
    e = extent(points)
    if e.xmin is None:
        return points.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("ci", "long"), ("cj", "long"), ("cx", "double"), ("cy", "double"))]).limit(0)
    h = width if height is None else height
    x, y = F.col("x") - F.lit(float(e.xmin)), F.col("y") - F.lit(float(e.ymin))
    if shape == "square":
        last_i, last_j = max(0, math.ceil((e.xmax - e.xmin) / width) - 1), max(0, math.ceil((e.ymax - e.ymin) / h) - 1)

        def both(v: Column, size: float, last: int) -> Column:
            c = F.floor(v / F.lit(float(size)))
            on_edge = c * F.lit(float(size)) == v
            return F.explode(F.filter(F.when(on_edge, F.array(c - 1, c)).otherwise(F.array(c)), lambda i: (i >= 0) & (i <= last)))

        out = points.withColumn("ci", both(x, width, last_i)).withColumn("cj", both(y, h, last_j))
        return out.withColumn("cx", (F.col("ci") + 0.5) * width + e.xmin).withColumn("cy", (F.col("cj") + 0.5) * h + e.ymin)
    if shape == "diamond":
        # centres (i * width, j * width / 2) with i and j alike in parity of halves: test the cells around
        cand = F.explode(F.array_distinct(F.flatten(F.transform(F.array(F.floor(x / width), F.floor(x / width) + 1, F.floor(x / width) - 1), lambda i: F.transform(F.array(F.floor(y / width), F.floor(y / width) + 1, F.floor(y / width) - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))))
        out = points.withColumn("c", cand)
        dx, dy = F.abs(x - F.col("c.i") * width), F.abs(y - (F.col("c.j") + 0.5) * width)
        out = out.where(dx + dy <= width / 2)
        return out.select("*", F.col("c.i").alias("ci"), F.col("c.j").alias("cj"), (F.col("c.i") * width + e.xmin).alias("cx"), ((F.col("c.j") + 0.5) * width + e.ymin).alias("cy")).drop("c")
    if shape == "hexagonal":
        # two interleaved lattices of hexagons whose centres are (1.5 i, j + i / 2 mod 1) in units of (width, 2 * width)
        i0 = F.floor(x / (1.5 * width))
        cand = F.explode(F.flatten(F.transform(F.sequence(i0 - 1, i0 + 2), lambda i: F.transform(F.sequence(F.floor(y / (2 * width)) - 1, F.floor(y / (2 * width)) + 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
        out = points.withColumn("c", cand)
        cx, cy = F.col("c.i") * 1.5 * width, (F.col("c.j") + F.when(F.pmod(F.col("c.i"), F.lit(2)) == 1, 0.5).otherwise(0.0)) * 2 * width
        dx, dy = F.abs(x - cx), F.abs(y - cy)
        inside = (dy <= width) & (dx <= width - dy / 2)
        out = out.where(inside)
        return out.select("*", F.col("c.i").alias("ci"), F.col("c.j").alias("cj"), (cx + e.xmin).alias("cx"), (cy + e.ymin).alias("cy")).drop("c")
    raise ValueError(f"unknown shape {shape!r}")


def labelgrid_aggregation(points: DataFrame, width: float, height: float | None = None, column: str | None = None, shape: str = "square") -> DataFrame:
    """A row a non-empty cell: ``ci, cj, cell_count``, the cell's centre ``x, y``, and ``{column}_total, _mean``."""
    c = grid_cells(points, width, height, shape)
    aggs = [F.count("*").alias("cell_count"), F.first("cx").alias("x"), F.first("cy").alias("y")]
    if column:
        aggs += [F.sum(column).alias(f"{column}_total"), F.avg(column).alias(f"{column}_mean")]
    return c.groupBy("ci", "cj").agg(*aggs)


def _best(rows: DataFrame, group: list[str], value: Column, largest: bool) -> DataFrame:
    """``group`` with ``best`` (the rid with the largest or smallest value) and ``n``; map-side combined."""
    pick = F.max_by("rid", F.struct(value, -F.col("rid"))) if largest else F.min_by("rid", F.struct(value, F.col("rid")))
    return rows.groupBy(*group).agg(pick.alias("best"), F.count("*").alias("n"))


def labelgrid_selection(points: DataFrame, width: float, height: float | None = None, column: str = "value", shape: str = "square", strict_positive: bool = True) -> DataFrame:
    """All rows with ``ci, cj``, ``selected_labelgrid`` on each cell's largest ``column`` (over 0, unless allowed), and its ``cell_count``."""
    c = grid_cells(points, width, height, shape)
    best = _best(c.where(F.col(column) > 0) if strict_positive else c, ["ci", "cj"], F.col(column), True).select("ci", "cj", "best")
    n = c.groupBy("ci", "cj").agg(F.count("*").alias("n"))
    out = c.join(n, ["ci", "cj"]).join(best, ["ci", "cj"], "left")
    hit = F.coalesce(F.col("rid") == F.col("best"), F.lit(False))
    return out.withColumn("selected_labelgrid", hit).withColumn("cell_count", F.when(hit, F.col("n"))).drop("best", "n", "cx", "cy")


def labelgrid_simplification(points: DataFrame, width: float, height: float | None = None, shape: str = "square") -> DataFrame:
    """All rows with ``ci, cj`` and ``selected_labelgrid`` on the row nearest to its cell's centre."""
    c = grid_cells(points, width, height, shape)
    d = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    best = _best(c, ["ci", "cj"], d, False).select("ci", "cj", "best")
    return c.join(best, ["ci", "cj"]).withColumn("selected_labelgrid", F.col("rid") == F.col("best")).drop("best", "cx", "cy")


def nearest_centre(centres: np.ndarray):
    """A function of ``(x, y)`` that gives each point's nearest centre, the first of equally near ones.

    Centres lie in a grid of about one a cell.  Rings of cells about a point's own are searched until none beyond can
    hold a nearer centre.
    """
    low, high = centres.min(0), centres.max(0)
    step = max(float((high - low).max()) / max(1.0, len(centres) ** 0.5), 1e-9)
    wide, tall = (np.floor((high - low) / step).astype(np.int64) + 1).tolist()
    place = np.floor((centres - low) / step).astype(np.int64)
    cell = place[:, 0] * tall + place[:, 1]
    order = np.argsort(cell, kind="stable")
    start = np.searchsorted(cell[order], np.arange(wide * tall + 1))

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        i = np.clip(np.floor((x - low[0]) / step), 0, wide - 1).astype(np.int64)
        j = np.clip(np.floor((y - low[1]) / step), 0, tall - 1).astype(np.int64)
        best, at, todo = np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.arange(len(x))
        for ring in range(max(wide, tall) + 1):
            for di in range(-ring, ring + 1):
                for dj in range(-ring, ring + 1) if abs(di) == ring else ((-ring, ring) if ring else (0,)):
                    a, b = i[todo] + di, j[todo] + dj
                    q = todo[(a >= 0) & (a < wide) & (b >= 0) & (b < tall)]
                    c = (i[q] + di) * tall + j[q] + dj
                    lo, hi = start[c], start[c + 1]
                    while len(q := q[(more := lo < hi)]):
                        lo, hi = lo[more], hi[more]
                        o = order[lo]
                        d = (x[q] - centres[o, 0]) ** 2 + (y[q] - centres[o, 1]) ** 2
                        hit = (d < best[q]) | ((d == best[q]) & (o < at[q]))
                        best[q[hit]], at[q[hit]] = d[hit], o[hit]
                        lo = lo + 1
            # what is beyond the ring is further than ``ring`` cells, by a hair's breadth of rounding at least
            todo = todo[~(best[todo] < (ring * step * (1 - 1e-9)) ** 2)]
            if not len(todo):
                break
        return at

    return near


# --- k-means -------------------------------------------------------------------------------------------------------


def kmeans_clusters(points: DataFrame, ratio: float, tolerance: float = 2.0, max_rounds: int | None = None) -> DataFrame:
    """``points`` with ``cluster, kx, ky``: Lloyd's algorithm on ``round(n * ratio)`` centres.

    Seeds are the points of smallest ``rid``.  Rounds end when no centre moves more than ``tolerance``, and clusters
    are those of the last round; an empty cluster keeps its centre.  Only where ``max_rounds`` is given do rounds end
    before that; else more than 10,000 raise.  Centres are kept as arrays on the driver and sent to each task (16 bytes
    a centre); a grid over them finds a point's nearest, ties to the earlier seed.
    """
    n = points.count()
    k = round(n * ratio)
    if k < 1:
        return points.select("*", F.lit(0).alias("cluster"), F.lit(0.0).alias("kx"), F.lit(0.0).alias("ky")).limit(0)
    seeds = points.orderBy("rid").limit(k).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).toArrow()  # a row a centre
    centres = np.column_stack([seeds.column(c).to_numpy() for c in ("x", "y")])

    def assigned() -> DataFrame:
        names, near = points.columns, nearest_centre(centres)

        def run(batches):
            for b in batches:
                at = near(*(b.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*names, "cluster"])

        return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType())]))

    for done in itertools.count(1):
        got = assigned().groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).toArrow()
        moved = centres.copy()
        moved[got.column("cluster").to_numpy()] = np.column_stack([got.column(c).to_numpy() for c in ("x", "y")])
        far = float(np.hypot(*(moved - centres).T).max())
        if far <= tolerance:
            break
        centres = moved
        if done == max_rounds:
            break
        if done == 10_000:
            raise RuntimeError(f"k-means: a centre still moves {far} after {done} rounds")
    out = assigned()
    means = out.groupBy("cluster").agg(F.avg("x").alias("kx"), F.avg("y").alias("ky"))
    return out.join(broadcast_if_small(means), "cluster")


def kmeans_selection(points: DataFrame, ratio: float, column: str, **how) -> DataFrame:
    c = materialize(kmeans_clusters(points, ratio, **how), "kmeans")
    best = _best(c.where(F.col(column) > 0), ["cluster"], F.col(column), True).select("cluster", "best")
    n = c.groupBy("cluster").agg(F.count("*").alias("n"))
    hit = F.coalesce(F.col("rid") == F.col("best"), F.lit(False))
    return c.join(n, "cluster").join(best, "cluster", "left").withColumn("selected_kmeans", hit).withColumn("cluster_count", F.when(hit, F.col("n"))).drop("best", "n", "kx", "ky", "cluster")


def kmeans_simplification(points: DataFrame, ratio: float, **how) -> DataFrame:
    c = materialize(kmeans_clusters(points, ratio, **how), "kmeans")
    d = (F.col("x") - F.col("kx")) * (F.col("x") - F.col("kx")) + (F.col("y") - F.col("ky")) * (F.col("y") - F.col("ky"))
    best = _best(c, ["cluster"], d, False).select("cluster", "best")
    return c.join(best, "cluster").withColumn("selected_kmeans", F.col("rid") == F.col("best")).drop("best", "kx", "ky", "cluster")


def kmeans_aggregation(points: DataFrame, ratio: float, column: str | None = None, **how) -> DataFrame:
    c = kmeans_clusters(points, ratio, **how)
    aggs = [F.count("*").alias("cluster_count"), F.avg("x").alias("x"), F.avg("y").alias("y")]
    if column:
        aggs += [F.sum(column).alias(f"{column}_total"), F.avg(column).alias(f"{column}_mean")]
    return c.groupBy("cluster").agg(*aggs).drop("cluster")


# --- quadtree ------------------------------------------------------------------------------------------------------


def quadtree_cells(points: DataFrame, depth: int) -> DataFrame:
    """``points`` with ``level, qi, qj, cx, cy``: a cell is split while it holds more than a point and is above ``depth``.

    The domain is the square of the longer side about the extent's centre; points on a dividing line go up and right.
    """
    e = extent(points)
    if e.xmin is None:
        return points.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("qi", "long"), ("qj", "long"), ("cx", "double"), ("cy", "double"))]).limit(0)
    side = max(e.xmax - e.xmin, e.ymax - e.ymin) or 1.0
    x0, y0 = (e.xmin + e.xmax - side) / 2, (e.ymin + e.ymax - side) / 2
    top = 1 << depth
    at = lambda v, v0: F.least(F.lit(top - 1), F.floor((v - F.lit(float(v0))) / F.lit(float(side)) * top)).cast("long")
    todo = points.withColumn("__i", at(F.col("x"), x0)).withColumn("__j", at(F.col("y"), y0))
    out = None
    for d in range(1, depth + 1):
        shift = depth - d
        keyed = todo.withColumn("qi", F.shiftright("__i", shift)).withColumn("qj", F.shiftright("__j", shift))
        if d == depth:
            part = keyed
        else:
            alone = keyed.groupBy("qi", "qj").agg(F.count("*").alias("n")).where("n = 1").select("qi", "qj")
            part = keyed.join(alone, ["qi", "qj"], "left_semi")
            todo = keyed.join(alone, ["qi", "qj"], "left_anti").drop("qi", "qj")
        w = side / (1 << d)
        part = part.withColumn("level", F.lit(d)).withColumn("cx", F.lit(float(x0)) + (F.col("qi") + 0.5) * w).withColumn("cy", F.lit(float(y0)) + (F.col("qj") + 0.5) * w)
        part = part.select(*points.columns, "level", "qi", "qj", "cx", "cy")
        out = part if out is None else out.union(part)
    return out


def quadtree_selection(points: DataFrame, depth: int, column: str) -> DataFrame:
    c = quadtree_cells(points, depth)
    keys = ["level", "qi", "qj"]
    best = _best(c.where(F.col(column) > 0), keys, F.col(column) * F.col("level"), True).select(*keys, "best")
    n = c.groupBy(*keys).agg(F.count("*").alias("n"))
    hit = F.coalesce(F.col("rid") == F.col("best"), F.lit(False))
    return c.join(n, keys).join(best, keys, "left").withColumn("selected_quadtree", hit).withColumn("cell_count", F.when(hit, F.col("n"))).drop("best", "n", "cx", "cy", *keys)


def quadtree_simplification(points: DataFrame, depth: int) -> DataFrame:
    c = quadtree_cells(points, depth)
    keys = ["level", "qi", "qj"]
    d = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    best = _best(c, keys, d, False).select(*keys, "best")
    return c.join(best, keys).withColumn("selected_quadtree", F.col("rid") == F.col("best")).drop("best", "cx", "cy", *keys)


def quadtree_aggregation(points: DataFrame, depth: int, column: str | None = None) -> DataFrame:
    c = quadtree_cells(points, depth)
    aggs = [F.count("*").alias("cell_count"), F.first("cx").alias("x"), F.first("cy").alias("y")]
    if column:
        aggs += [F.sum(column).alias(f"{column}_total"), F.avg(column).alias(f"{column}_mean")]
    return c.groupBy("level", "qi", "qj").agg(*aggs)


# --- heatmap -------------------------------------------------------------------------------------------------------


def _kernel(method: str, u: Column) -> Column:
    return {
        "quartic": 15 / 16 * (1 - u * u) * (1 - u * u),
        "epanechnikov": 3 / 4 * (1 - u * u),
        "gaussian": 1 / math.sqrt(2 * math.pi) * F.exp(-u * u / 2),
        "uniform": F.lit(0.5),
        "triangular": 1 - F.abs(u),
    }[method]


def heatmap(points: DataFrame, cell_size: float, radius: float | str, column: str | None = None, method: str = "quartic") -> DataFrame:
    """``(ci, cj, x, y, density)`` on a square grid over the extent; ``radius`` is a number or a column.

    A cell sums the kernel, times ``column``, over the points whose ``radius`` reaches its centre.  Each point
    generates the cells it reaches (a bounded number), and sums combine map-side: no cell meets a point it doesn't use.
    """
    e = extent(points)
    if e.xmin is None:
        return points.sparkSession.createDataFrame([], "ci long, cj long, x double, y double, density double")
    nx, ny = max(0, math.ceil((e.xmax - e.xmin) / cell_size)), max(0, math.ceil((e.ymax - e.ymin) / cell_size))
    # as many steps as a half-open range up to one cell past the maximum holds, less one
    nx, ny = max(nx, 0), max(ny, 0)
    r = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    size = F.lit(float(cell_size))

    def span(v: str, lo: float, n: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(v) - r - lo) / size - 0.5) - 1)
        last = F.least(F.lit(n - 1), F.floor((F.col(v) + r - lo) / size - 0.5) + 1)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    hit = points.withColumn("r", r).withColumn("ci", F.explode(span("x", e.xmin, nx))).withColumn("cj", F.explode(span("y", e.ymin, ny)))
    cx, cy = F.lit(float(e.xmin)) + (F.col("ci") + 0.5) * size, F.lit(float(e.ymin)) + (F.col("cj") + 0.5) * size
    d = F.sqrt((cx - F.col("x")) * (cx - F.col("x")) + (cy - F.col("y")) * (cy - F.col("y")))
    weight = F.col(column) if column else F.lit(1.0)
    sums = hit.where(d <= F.col("r")).groupBy("ci", "cj").agg(F.sum(_kernel(method, d / F.col("r")) * weight).alias("density"))
    grid = points.sparkSession.range(nx * ny).select(F.expr(f"id div {max(ny, 1)}").alias("ci"), (F.col("id") % max(ny, 1)).alias("cj"))
    return grid.join(sums, ["ci", "cj"], "left").select("ci", "cj", cx.alias("x"), cy.alias("y"), F.coalesce("density", F.lit(0.0)).alias("density"))
