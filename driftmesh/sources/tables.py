"""Trajectories and baskets from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmesh.operators.ranking import rank_keys


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_samples(rows: DataFrame) -> DataFrame:
    """Samples from rows of trajectory_id, ord, x, y, t: indices and sequence numbers.

    Trajectories are numbered by id, samples of each by t and then ``ord``.
    """
    index = rank_keys(rows, ["trajectory_id"], "trajectory_idx")
    order = Window.partitionBy("trajectory_id").orderBy("t", "ord")
    numbered = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    return numbered.join(index, "trajectory_id").select("trajectory_idx", "trajectory_id", "seq", "x", "y", "t", "ord")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as points: x the value, y the property k, t hours into 2024."""
    hours = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("trajectory_id"),
        F.col("event_id").alias("ord"),
        F.floor("value").cast("long").alias("x"),
        F.get_json_object("props", "$.k").cast("long").alias("y"),
        hours.cast("long").alias("t"),
    )


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    return as_samples(event_rows(spark, folder))


def order_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as points of customers: x thousands, y priority, t days since 1995."""
    rows = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("trajectory_id"),
        F.col("o_orderkey").alias("ord"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("x"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("y"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("t"),
    )
    return as_samples(rows)


def supply_items(spark: SparkSession, folder: str) -> DataFrame:
    """trajectory_idx, item_id: per order the nations (from 0) and regions (from 100)
    of its suppliers; a nation implies its region."""
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("trajectory_idx"), "l_suppkey")
    suppliers = read_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nations = read_table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    placed = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    items = F.explode(F.array(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long") + 100))
    return placed.select("trajectory_idx", items.alias("item_id")).distinct()
