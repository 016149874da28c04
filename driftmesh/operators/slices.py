"""Sliding windows over the rank of distinct ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.ranking import rank_keys


def tick_slices(samples: DataFrame, size: int = 4, step: int = 1) -> DataFrame:
    """slice_id, t: slice i has the ticks of rank i * step up to i * step + size - 1."""
    ranked = rank_keys(samples, ["t"], "rank")
    total = ranked.agg(F.ceil(F.count("*") / step).cast("long").alias("n_slices"))
    first = F.greatest(F.ceil((F.col("rank") - size + 1) / F.lit(step)), F.lit(0)).cast("long")
    last = F.least(F.floor(F.col("rank") / F.lit(step)), F.col("n_slices") - 1).cast("long")
    held = ranked.join(F.broadcast(total)).withColumn("first", first).withColumn("last", last)  # one row
    return held.filter("first <= last").select(F.explode(F.sequence("first", "last")).alias("slice_id"), "t")


def timeslice(samples: DataFrame, size: int = 4, step: int = 1) -> DataFrame:
    """Samples with the slices they fall into, once for each."""
    return samples.join(tick_slices(samples, size, step), "t").select("slice_id", *samples.columns)


def slice_sizes(samples: DataFrame, size: int = 4, step: int = 1) -> DataFrame:
    """slice_id, trajectory_idx, n_samples: every trajectory is in every slice, if empty."""
    counted = timeslice(samples, size, step).groupBy("slice_id", "trajectory_idx").agg(F.count("*").alias("n_samples"))
    slices = tick_slices(samples, size, step).select("slice_id").distinct()
    everyone = slices.crossJoin(samples.select("trajectory_idx").distinct())  # the result itself has these rows
    return everyone.join(counted, ["slice_id", "trajectory_idx"], "left").fillna(0, ["n_samples"])
