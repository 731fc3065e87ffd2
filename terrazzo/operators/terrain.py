"""Terrain on rasters in long form ``(row, col, z)``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shifted(dem: DataFrame, reach: int = 1) -> DataFrame:
    """Cells with their neighbourhood as ``map<struct, z>``-like columns: each value goes to the cells that read it.

    An explode and one aggregation on ``(row, col)``: neighbours meet without ordering whole rows in a task.
    """
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    moves = F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(f"{i},{j}").alias("k"), F.col("z").alias("z")) for i, j in steps])
    wide = dem.select(F.explode(moves).alias("m")).select("m.*").groupBy("row", "col")
    return wide.agg(*[F.max(F.when(F.col("k") == f"{i},{j}", F.col("z"))).alias(f"z{i}_{j}".replace("-", "m")) for i, j in steps]).where("z0_0 is not null")


def slope_and_laplacian(dem: DataFrame, cell: float) -> DataFrame:
    """``(row, col, slope, laplacian)`` at cells at least two from the border.

    Gradients and their gradients by central differences, so the second ones span four cells.
    """
    n = _shifted(dem, 2)
    zx, zy = (F.col("z0_1") - F.col("z0_m1")) / (2 * cell), (F.col("z1_0") - F.col("zm1_0")) / (2 * cell)
    lap = (F.col("z0_2") - 2 * F.col("z0_0") + F.col("z0_m2")) / (4 * cell * cell) + (F.col("z2_0") - 2 * F.col("z0_0") + F.col("zm2_0")) / (4 * cell * cell)
    return n.select("row", "col", F.sqrt(zx * zx + zy * zy).alias("slope"), lap.alias("laplacian")).where("laplacian is not null and slope is not null")


def hillshade(dem: DataFrame, azimuth: float, altitude: float, cell: float = 1.0) -> DataFrame:
    """``(row, col, shade)`` in 0..1 at inner cells, by Horn's weights."""
    n = _shifted(dem, 1).dropna()  # cells with all eight neighbours
    c = lambda i, j: F.col(f"z{i}_{j}".replace("-", "m"))
    # convolution turns the kernel over, hence the signs
    gx = -((c(-1, 1) + 2 * c(0, 1) + c(1, 1)) - (c(-1, -1) + 2 * c(0, -1) + c(1, -1))) / (8 * cell)
    gy = -((c(-1, -1) + 2 * c(-1, 0) + c(-1, 1)) - (c(1, -1) + 2 * c(1, 0) + c(1, 1))) / (8 * cell)
    slope, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    az, ze = math.radians(450 - azimuth), math.pi / 2 - math.radians(altitude)
    shade = math.cos(ze) * F.cos(slope) + math.sin(ze) * F.sin(slope) * F.cos(az - aspect)
    return n.select("row", "col", F.least(F.lit(1.0), F.greatest(F.lit(0.0), shade)).alias("shade"))


def mean_filter(dem: DataFrame, size: int) -> DataFrame:
    """``(row, col, z)``: means of ``size`` by ``size`` neighbourhoods, clipped at the border; one axis at a time."""
    h = size // 2
    for axis in ("row", "col"):
        other = "col" if axis == "row" else "row"
        spread = dem.select(F.explode(F.sequence(F.col(axis) - h, F.col(axis) + h)).alias(axis), other, "z")
        sums = spread.groupBy("row", "col").agg(F.avg("z").alias("m"))
        dem = dem.join(sums, ["row", "col"]).select("row", "col", F.col("m").alias("z"))
    return dem


def plane_filter(points: DataFrame, epsilon: float, plane: tuple[float, float, float, float]) -> DataFrame:
    """Points ``(x, y, z)`` farther than ``epsilon`` from the plane ``ax + by + cz + d = 0``."""
    a, b, c, d = plane
    return points.where(F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d) / math.sqrt(a * a + b * b + c * c) > epsilon)


def sculpt(dem: DataFrame, base_size: int = 15, curvature_size: int = 9, exaggeration: float = 1.5, excavation: float = 1.5, slope_threshold: float = 0.05, cell: float = 1.0) -> DataFrame:
    """``(row, col, z)``: detail over a smoothed base is exaggerated on crests and excavated in valleys; flat land stays."""
    base = mean_filter(dem, base_size).withColumnRenamed("z", "base")
    curve = slope_and_laplacian(mean_filter(dem, curvature_size), cell)
    j = dem.join(base, ["row", "col"]).join(curve, ["row", "col"], "left")
    factor = F.when(F.col("laplacian") < 0, exaggeration).when(F.col("laplacian") > 0, excavation).otherwise(1.0)
    z = F.when(F.col("slope") > slope_threshold, F.col("base") + (F.col("z") - F.col("base")) * factor).otherwise(F.col("z"))
    return j.select("row", "col", z.alias("z"))
