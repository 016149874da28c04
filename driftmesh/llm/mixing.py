"""Mixing sources to target weights.

Words are summed per source, targets follow the weights, and every document is
emitted ``floor(rate)`` times plus one more time with probability equal to the
fraction of the rate, decided by a hash of its id.

Targets are a water level: ``min(limit * size, level * weight)`` with one level
for all sources such that the targets add up to the budget. Resharing the excess
by weight until no source is above its limit ends at the same place, and the
level is found in one ordered pass over one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.llm.columns import with_columns, word_count
from driftmesh.storage import materialize

#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate.

    ``sizes`` has columns source and size. Sources are ordered by code point with
    null last and take the weights in turn. An empty table gives no rows; a source
    without words has target 0 and rate 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    ranked = per_source.withColumn("weight", F.get(wheel, (F.row_number().over(by_name) - 1) % len(weights)))
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_height = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_height.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_height.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = (
        ranked.withColumn("cap", F.lit(limit) * F.col("source_size"))
        .withColumn("total", F.lit(budget) * F.sum("source_size").over(everyone))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    water = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everyone)
    target = F.when(F.col("full"), F.col("cap")).otherwise(water["level"] * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target", rate.alias("rate"))


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``key`` only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (times to emit).

    Null texts and texts without words have size 0 and get copies like any other.
    Null sources form one source, null ids share one draw, repeated rows draw
    alike. A clashing column name is replaced. No rows in, no rows out.
    """
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = materialize(source_targets(sized, weights, budget, limit), "mix-targets")
    targets = targets.select(*[F.col(c).alias(f"__mix_{c}") for c in targets.columns])
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = docs.join(targets, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    rate = F.col("__mix_rate")
    extra = hashed_uniform(F.col(id_col), seed) < rate - F.floor(rate)
    new = {
        "size": word_count(F.col(text_col)),
        "source_size": F.col("__mix_source_size"),
        "target": F.col("__mix_target"),
        "copies": (F.floor(rate) + extra.cast("long")).cast("long"),
    }
    return with_columns(joined, new).drop(*targets.columns)


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1 in column copy; ``copies`` 0 vanishes."""
    chosen = mixed.filter(F.col("copies") > 0)
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
