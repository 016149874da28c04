"""Readable lines of datasets, cells, itemsets, cliques and groups, made where the data is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.sources import binary


def _point(s: Column) -> Column:
    return F.format_string("(%d, %d, %d)", s["x"], s["y"], s["t"])


def _list(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), " ")


def format_samples(samples: DataFrame) -> DataFrame:
    """line, text: a trajectory's id and points in order."""
    path = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "t")))
    rows = samples.groupBy("trajectory_idx").agg(F.first("trajectory_id").alias("name"), path.alias("path"))
    points = F.array_join(F.transform("path", _point), " ")
    return rows.select(F.col("trajectory_idx").alias("line"), F.format_string("%5d: %s", "name", points).alias("text"))


def format_itemsets(itemsets: DataFrame) -> DataFrame:
    text = F.format_string("%d: {%s} x %d", F.col("itemset_id"), _list(F.col("items")), F.col("support"))
    return itemsets.select(F.col("itemset_id").alias("line"), text.alias("text"))


def format_members(groups: DataFrame, name: str = "group_id") -> DataFrame:
    """Groups, or cliques by ``itemset_id``: id, size and members."""
    members = F.array_sort(F.collect_list("trajectory_idx"))
    rows = groups.groupBy(F.col(name).alias("line")).agg(members.alias("m"))
    return rows.select("line", F.format_string("%d (%d): %s", F.col("line"), F.size("m"), _list(F.col("m"))).alias("text"))


def format_edges(edges: DataFrame) -> DataFrame:
    """The rows of a weight matrix, one line per trajectory with its non-zero weights."""
    cell = F.struct("t2", F.format_string("%d:%.6f", "t2", F.col("w").cast("double")).alias("cell"))
    rows = edges.groupBy(F.col("t1").alias("line")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("line", F.array_join(F.transform("cells", lambda c: c["cell"]), " ").alias("text"))


def print_lines(lines: DataFrame, limit: int = 20) -> None:
    """The first lines on standard output."""
    for row in lines.orderBy("line").limit(limit).collect():
        print(row["text"])


def scan_and_print(spark: SparkSession, path: str, header: int = 3, limit: int = 20) -> None:
    """A binary dataset (header 3) or map (header 4), read back and printed."""
    print_lines(format_samples(binary.read_samples(spark, path, header)), limit)
