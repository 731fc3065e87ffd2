"""Label-grid counts over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_grid_counts(points: DataFrame, cell: float, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """``(window, ci, cj, n)``: points ``(ts, x, y)`` counted by tumbling window and square cell of origin 0."""
    p = points.withWatermark(time, late) if points.isStreaming else points
    return p.groupBy(F.window(time, window), F.floor(F.col("x") / cell).alias("ci"), F.floor(F.col("y") / cell).alias("cj")).agg(F.count("*").alias("n"))
