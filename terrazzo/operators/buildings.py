"""Building constraints, monitors and their agents, as expressions on areas and rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import geometry as G
from terrazzo.functions.udfs import line_function
from terrazzo.operators import mcda


def size_goal(area: Column, min_area: float, elimination: float) -> Column:
    """0 under the elimination threshold, the own area over the minimum, else the minimum."""
    return F.when(area < elimination, 0.0).when(area > min_area, area).otherwise(F.lit(float(min_area)))


def size_satisfaction(area: Column, min_area: float, elimination: float) -> Column:
    goal = size_goal(area, min_area, elimination)
    return F.when(goal == 0, 0.0).when(area > goal, 100.0).otherwise(100 - 100 * F.abs((area - goal) / goal))


def granularity(ring: Column, min_length: float) -> Column:
    """Root of the share of too short edges times their mean relative deficit."""
    short = F.filter(F.transform(G.segments(ring), lambda s: F.hypot(s.x2 - s.x1, s.y2 - s.y1)), lambda n: n < min_length)
    deficit = F.aggregate(short, F.lit(0.0), lambda a, n: a + (min_length - n)) / F.size(short)
    return F.when(F.size(short) == 0, 0.0).otherwise(F.sqrt(F.size(short) / (F.size(ring) - 1) * deficit / min_length))


def monitor_goal(initial: Column, target: float, epsilon: float = 0.001) -> Column:
    """Target under the target area, the initial area over twice it, and a line between."""
    a, b = (1.0 - 2.0 * epsilon) / target, target - 1.0 + 3.0 * epsilon
    return F.when(initial < target, F.lit(float(target))).when(initial < 2 * target, a * initial + b).otherwise(initial)


def size_monitor(current: Column, initial: Column, target: float, epsilon: float = 0.001) -> Column:
    """Satisfaction 1 (unacceptable) to 8 (perfect) by the share of the goal reached."""
    g = monitor_goal(initial, target, epsilon)
    return (
        F.when(F.abs(g - current) < epsilon, 8).when(current > g, 7).when(current > 5 * g / 6, 6).when(current > 3 * g / 4, 5)
        .when(current > g / 2, 4).when(current > g / 3, 3).when(current > g / 4, 2).otherwise(1)
    )


def position_monitor(moved: Column, goal: float, epsilon: float = 0.001) -> Column:
    """Satisfaction 1 to 8 by how far an object was moved, against the distance that may be; 7 for null."""
    rungs = [(moved < goal * k, level) for k, level in ((0.25, 7), (0.5, 6))] + [(moved <= goal, 5)] + [(moved < goal * k, level) for k, level in ((1.5, 4), (2.0, 3), (2.5, 2))]
    out = F.when(moved.isNull(), 7).when(moved < epsilon, 8)
    for met, level in rungs:
        out = out.when(met, level)
    return out.otherwise(1)


def granularity_monitor(line: Column, min_length: float, epsilon: float) -> Column:
    """Satisfaction 1 to 8 by a ring's or line's shortest edge and its vertices a unit of length; 7 for null, 1 for one without length."""
    edge, density = G.shortest_edge(line), F.try_divide(F.size(line), G.length(line))
    over = lambda share: edge > share * min_length
    return (
        F.when(line.isNull(), 7).when(edge >= min_length, 8).when(over(0.75) & (density < epsilon), 7).when(density < epsilon, 6)
        .when(over(0.75) & (density < 2 * epsilon), 5).when(over(0.5) & (density < 2 * epsilon), 4)
        .when(over(0.5) & (density > 2 * epsilon), 3).when(over(0.25) & (density > 2 * epsilon), 2).otherwise(1)
    )


def elimination_criteria(buildings: DataFrame, min_area: float, threshold: float = 70.0) -> DataFrame:
    """``(block, rid, size, congestion, directions, corner, neighbours)``: what speaks for a building's removal.

    ``buildings`` are ``(block, rid, area, corner, directions, n_building_edges, n_edges)``, with the congestion by
    direction as an array.  An area under ``min_area`` counts as that where they are over 15 apart; up to the threshold
    size is 1 and falls beyond in two slopes.  Without congested directions or edges, the criterion is 0.
    """
    area = F.when(F.lit(float(min_area)) - F.col("area") > 15, F.lit(float(min_area))).otherwise(F.col("area"))
    size = F.when(area <= threshold, 1.0).when(area <= 2 * threshold, 1 - (area + 1) / (2 * threshold)).otherwise(1 - area / (4 * threshold))
    over = lambda least: F.filter("directions", lambda c: c > least)
    mean = F.when(F.size(over(0.0)) > 0, F.try_divide(F.aggregate(over(0.0), F.lit(0.0), lambda a, c: a + c), F.size(over(0.0)))).otherwise(0.0)
    return buildings.select(
        "block", "rid", size.alias("size"), mean.alias("congestion"), F.size(over(0.08)).cast("double").alias("directions"),
        F.col("corner").cast("double").alias("corner"), F.when(F.col("n_edges") > 0, F.try_divide("n_building_edges", "n_edges")).otherwise(0.0).alias("neighbours"),
    )


def _elimination() -> list:
    """Criteria, preference functions and weights of the removal of a building from its block."""
    # Fixed values. Full preference is set to begin under the bound up to which there is none, so all five are steps.
    return [
        ("size", mcda.linear(0.1, 0.7), 0.2), ("congestion", mcda.level(0.2, 0.4), 0.2), ("directions", mcda.level(0.2, 0.4), 0.2),
        ("corner", mcda.u_shape(0.5), 0.2), ("neighbours", mcda.linear(0.15, 0.6), 0.2),
    ]


def elimination_ranking(buildings: DataFrame, min_area: float, threshold: float = 70.0) -> DataFrame:
    """``(block, rid, phi, rank)``: each block's buildings by ascending net flow; see ``elimination_criteria``."""
    return mcda.promethee(elimination_criteria(buildings, min_area, threshold), "block", "rid", _elimination())


def elimination_best(buildings: DataFrame, min_area: float, threshold: float = 70.0) -> DataFrame:
    """``(block, rid)``: the building of each block that is best removed."""
    return mcda.best(elimination_criteria(buildings, min_area, threshold), "block", "rid", _elimination())


def block_density_satisfaction(now: Column, goal: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - F.bround(F.abs(now - goal) / 0.003))


def block_proximity_satisfaction(overlap: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - F.bround(overlap / 0.005))


def block_density(buildings: DataFrame, blocks: DataFrame, min_size: float = 0.0) -> DataFrame:
    """``(block, density)``: built area (each building counted as ``min_size`` at least) over block area."""
    built = buildings.groupBy("block").agg(F.sum(F.greatest(F.col("area"), F.lit(float(min_size)))).alias("built"))
    return blocks.join(built, "block", "left").select("block", (F.coalesce("built", F.lit(0.0)) / F.col("area")).alias("density"))


def generalize_buildings(buildings: DataFrame, min_area: float, elimination: float, angle: float = 8.0) -> DataFrame:
    """One round of size and squareness agents on ``(rid, geom)``: too small go, small grow to the minimum, corners are squared.

    A change is kept only when it leaves the area within a quarter of its goal; rows are independent of each other.
    """
    b = buildings.withColumn("__a", G.area(F.col("geom"))).where(F.col("__a") >= elimination)
    grown = F.transform("geom", lambda p: F.struct(*[(F.col("__c")[k] + (p[k] - F.col("__c")[k]) * F.sqrt(F.lit(float(min_area)) / F.col("__a"))).alias(k) for k in "xy"]))
    b = b.withColumn("__c", G.centroid(F.col("geom"))).withColumn("geom", F.when((F.col("__a") < min_area) & F.col("__c").isNotNull(), grown).otherwise(F.col("geom")))
    b = b.withColumn("__s", line_function("square_polygon_edges", tolerance=angle)("geom"))
    now, was = G.area(F.col("__s")), G.area(F.col("geom"))
    return b.withColumn("geom", F.when(F.abs(now - was) <= was / 4, F.col("__s")).otherwise(F.col("geom"))).drop("__a", "__c", "__s")


def typification_grid(buildings: DataFrame, ratio: float, cell: float = 500.0) -> DataFrame:
    """``(rid, ci, cj, keep)``: per cell of ``cell`` units the ``max(1, round(n * ratio))`` largest buildings stay."""
    from pyspark.sql import Window as W

    c = buildings.select("rid", G.centroid(F.col("geom")).alias("p"), G.area(F.col("geom")).alias("area"))
    c = c.select("rid", F.floor(F.col("p.x") / cell).alias("ci"), F.floor(F.col("p.y") / cell).alias("cj"), "area")
    # no join: its keys' null checks would be pushed down to the table, the geometry spelt out in every lambda
    by = W.partitionBy("ci", "cj")
    c = c.withColumn("n", F.count("ci").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("area"), "rid"))).where("n > 0")
    return c.select("rid", "ci", "cj", (F.col("r") <= F.greatest(F.lit(1), F.bround(F.col("n") * ratio).cast("int"))).alias("keep"))


def building_congestion(edges: DataFrame, max_distance: float, orientations: int = 16) -> DataFrame:
    """``(rid, congestion, n_building_edges)`` from proximity edges ``(rid, x1, y1, x2, y2, to_building)``.

    An edge's congestion ``1 - length / max_distance`` counts for directions up to 45 degrees from its own (folded to
    0..180 degrees), linearly less; a direction takes the largest.  Longer edges don't count.
    """
    step = 2 * math.pi / orientations
    e = edges.withColumn("size", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where(F.col("size") <= max_distance)
    a = F.pmod(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.pi())
    e = e.withColumn("c", 1 - F.col("size") / max_distance).withColumn("a", a)
    part = lambda i: F.greatest(F.lit(0.0), F.col("c") * (1 - 4 * F.abs(F.col("a") - i * step) / math.pi))
    each = [F.max(part(i)).alias(f"d{i}") for i in range(orientations)]
    out = e.groupBy("rid").agg(*each, F.count(F.when(F.col("to_building"), 1)).alias("n_building_edges"))
    return out.select("rid", F.array(*[f"d{i}" for i in range(orientations)]).alias("congestion"), "n_building_edges")
