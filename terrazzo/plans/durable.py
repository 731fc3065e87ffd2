"""Lineage cuts that survive lost executors, size-checked broadcasts, and spreading of small tables.

Intermediate tables are Parquet in the shared folder named by ``spark.checkpoint.dir``.  Only where
that setting is absent (tests, notebooks) a local folder is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="terrazzo-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/terrazzo/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrazzo_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`."""
    path = getattr(df, "_terrazzo_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast when it is measured to hold at most ``max_rows`` rows; else leave the join to Catalyst.

    ``df`` should be materialised: it is counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows to all cores by ``key``: a table of few bytes comes in few partitions, however much is computed from a row."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, 32), key)
