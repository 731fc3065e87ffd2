"""Points, lines, buildings, networks and rasters derived by rule from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions.geometry import point
from terrazzo.plans.durable import spread


def points_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("rid"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"), F.col("label").cast("long").alias("value"))


def points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("rid"), (F.col("user_id") * 50.0 + F.col("event_id") % 50).cast("double").alias("x"), F.col("value").alias("y"), (1 + F.col("event_id") % 9).cast("double").alias("w"), (10 + F.col("event_id") % 15).cast("double").alias("r"))


def lines_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three or more vertices ``(10 * position, quantity)``."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    g = li.groupBy(F.col("l_orderkey").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("v"))
    vertex = lambda v, i: F.struct(((i + 1) * 10.0).cast("double").alias("x"), v.l_quantity.cast("double").alias("y"))
    return g.where(F.size("v") >= 3).select("rid", F.transform("v", vertex).alias("geom"))


def buildings_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, every third cut to an L."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("rid"), F.col("p_size")), "rid")
    p = p.withColumn("cx", (F.col("rid") % 50) * 40.0).withColumn("cy", F.floor(F.col("rid") / 50) * 40.0).withColumn("w", 8 + F.col("p_size") * 0.3).withColumn("h", 6.0 + (F.col("rid") % 7) * 2)
    x = lambda k: F.col("cx") + F.col("w") * k
    y = lambda k: F.col("cy") + F.col("h") * k
    box = F.array(point(x(-0.5), y(-0.5)), point(x(0.5), y(-0.5)), point(x(0.5), y(0.5)), point(x(-0.5), y(0.5)), point(x(-0.5), y(-0.5)))
    ell = F.array(point(x(-0.5), y(-0.5)), point(x(0.5), y(-0.5)), point(x(0.5), y(0.0)), point(x(0.0), y(0.0)), point(x(0.0), y(0.5)), point(x(-0.5), y(0.5)), point(x(-0.5), y(-0.5)))
    # exploded, so that filters on what is computed from it aren't pushed down with the whole expression in each of their lambdas
    return p.select("rid", F.explode(F.array(F.when(F.col("rid") % 3 == 0, ell).otherwise(box))).alias("geom"))


def roads_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice with gaps: edges right or up from nodes 100 apart."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 400).alias("s"), (F.col("o_orderkey") % 2).alias("dir")).distinct().where("(s * 7 + dir * 3) % 5 <> 0")
    x, y = (F.col("s") % 20) * 100.0, F.floor(F.col("s") / 20) * 100.0
    end = F.when(F.col("dir") == 0, point(x + 100, y)).otherwise(point(x, y + 100))
    return o.select((F.col("s") * 2 + F.col("dir")).cast("long").alias("rid"), F.array(point(x, y), end).alias("geom"))


def rivers_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer k flows to k / 2."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")).where("k >= 2")
    return c.select(F.col("k").alias("rid"), F.col("k").alias("src"), F.expr("k div 2").alias("dst"), (1 + F.col("k") % 5).cast("double").alias("length"))


def dtm(spark: SparkSession, n: int = 64) -> DataFrame:
    g = spark.range(n * n).select(F.expr(f"id div {n}").alias("row"), (F.col("id") % n).alias("col"))
    return g.withColumn("z", 100.0 + (F.col("row") * F.col("row")) % 37 + (F.col("col") * 3) % 29 + 0.5 * F.col("row"))


def ring_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular 24-gons, an edge a line, with four spokes outwards; for every 40th part, 500 apart."""
    k = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")).where("k % 40 = 0")
    k = k.select("k", (10.0 + F.col("k") % 30).alias("r"), (F.floor(F.col("k") / 40) * 500.0).alias("cx"), F.explode(F.sequence(F.lit(0), F.lit(27))).alias("i"))
    at = lambda i, r: point(F.col("cx") + r * F.cos(i * F.pi() / 12), r * F.sin(i * F.pi() / 12))
    edge = F.array(at(F.col("i"), F.col("r")), at((F.col("i") + 1) % 24, F.col("r")))
    spoke = F.array(at((F.col("i") - 24) * 6, F.col("r")), at((F.col("i") - 24) * 6, F.col("r") + 50))
    return k.select((F.col("k") * 100 + F.col("i")).cast("long").alias("rid"), F.when(F.col("i") < 24, edge).otherwise(spoke).alias("geom"))


def crossing_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and upright lines 200 long, that cross, touch and overlap, from customers."""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("rid")), "rid")
    x, y = (F.col("rid") % 29) * 40.0, (F.floor(F.col("rid") / 29) % 31) * 40.0
    end = F.when(F.col("rid") % 2 == 0, point(x + 200, y)).otherwise(point(x, y + 200))
    return c.select("rid", F.array(point(x, y), end).alias("geom"))
