"""Cell counts over a stream of samples: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.functions.grid import rollup


def windowed_cells(stream: DataFrame, bits: int, ts: str = "ts", size: str = "4 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, x, y, n_samples per window and cell; rows later than ``late`` are dropped."""
    cells = stream.withWatermark(ts, late).select(ts, rollup(F.col("x"), bits).alias("x"), rollup(F.col("y"), bits).alias("y"))
    counted = cells.groupBy(F.window(ts, size, slide).alias("w"), "x", "y").agg(F.count("*").alias("n_samples"))
    return counted.select(F.col("w.start").alias("start"), "x", "y", "n_samples")
