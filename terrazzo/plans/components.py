"""Connected components of an edge table by alternating large-star and small-star rounds.

Nodes stay distributed; hubs are handled by map-side minima and by joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a")
    return (
        linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .where("a <> b")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node reachable.

    Nulls and self-loops: an edge with a null end is ignored; a node known only from a self-loop is its own
    component.  An empty table gives an empty result.
    """
    e0 = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    cur = materialize(e0.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = materialize(cur.where("a = b").select("a"), "loops")
    live, mark = cur.where("a <> b"), None
    for _ in range(max_rounds):
        nxt = materialize(_small_star(_large_star(live)), "stars")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if cur is not None:
            discard(cur)
        cur = live = nxt
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    nodes = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = live.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return nodes.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
