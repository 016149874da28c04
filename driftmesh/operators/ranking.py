"""Numbering the distinct keys of a table in order, without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.storage import materialize


def rank_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct ``keys`` with their position from 0 in column ``name``.

    Keys are dealt to ranges, numbered within each range, and shifted by the sizes
    of the ranges before; only those sizes, one per range, are broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(*keys).distinct().repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")
    shifts = sizes.select("__range", before.alias("__before"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    numbered = ranged.withColumn("__at", at).join(F.broadcast(shifts), "__range")
    return numbered.select(*keys, (F.col("__before") + F.col("__at")).cast("long").alias(name))


def ranked_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows of ``df`` with their position from 0 in order of ``keys``, equal ones in any order.

    As ``rank_keys``, with whole rows written in order instead of keys to be joined.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number grows within a range by one a row; its upper bits are the range
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranked").withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")
    shifts = sizes.select("__range", before.alias("__before"))
    placed = ranged.join(F.broadcast(shifts), "__range").withColumn(name, F.col("__before") + F.col("__at"))
    return placed.drop("__range", "__at", "__before")


#: Parts of a group that are cut to the first rows by themselves.
SALTS = 32


def first_of(df: DataFrame, by: list[str], order: list, k: int, salt: str, rank: str, salts: int = SALTS) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with their place from 1 in column ``rank``.

    Parts of a group, dealt by a hash of ``salt``, are cut to their first ``k`` rows; only
    those, at most ``k`` for each part, meet in the group's own task.
    """
    part = F.pmod(F.xxhash64(salt), F.lit(salts))
    own = df.withColumn("__part", part).withColumn(rank, F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    left = own.filter(F.col(rank) <= k).drop(rank, "__part")
    return left.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)
