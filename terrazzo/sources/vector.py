"""GeoJSON and WKT readers and writers, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.functions import geometry as G


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(properties, geom)`` of the LineString features of GeoJSON files (whole-file JSON)."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    f = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("features").alias("f"))
    point = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    return f.where("f.geometry.type = 'LineString'").select("f.properties", F.transform("f.geometry.coordinates", point).alias("geom"))


def write_geojson_lines(df: DataFrame, path: str) -> None:
    """One GeoJSON feature a line, with the other columns as properties."""
    rest = [c for c in df.columns if c != "geom"]
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("geom", lambda p: F.array(p.x, p.y)).alias("coordinates"))
    df.select(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties")).write.json(path)


def read_wkt(spark: SparkSession, path: str, column: str = "wkt") -> DataFrame:
    """A CSV table with a WKT column, and its vertices as ``geom``."""
    return spark.read.option("header", "true").csv(path).withColumn("geom", G.from_wkt(F.col(column)))


def explode_multi(df: DataFrame, column: str = "geom") -> DataFrame:
    """A row for each part of multi-lines ``array<line>``, the other columns repeated; null and empty ones go."""
    return df.withColumn(column, F.explode(column))


def seeded_sample(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of ``key`` and ``seed``: alike in every run and partitioning."""
    top = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(top)) < round(fraction * top))
