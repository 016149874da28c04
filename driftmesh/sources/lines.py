"""The text formats: one record a line, named by its line number from 0.

Encoders give (line, text) and decoders read the same, so that text can come from
files or from a table. Tokens that are no numbers are ignored, and records with a
bad id are left out, both with ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmesh.operators.ranking import rank_keys
from driftmesh.storage import materialize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, text of a file, or of a folder's files in order of their names.

    Rows of one block come from one task in order; blocks are numbered by file and
    place in it, and each begins where those before it end.
    """
    block = ["__file", "__start"]
    named = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    placed = materialize(named.withColumn("__at", F.monotonically_increasing_id()), "lines")
    sizes = placed.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.orderBy(*block)) - F.col("__n")  # one row per block
    shifts = sizes.withColumn("__before", before).select(*block, "__before", "__first")
    line = F.col("__before") + F.col("__at") - F.col("__first")
    return placed.join(shifts, block).select(line.cast("long").alias("line"), F.col("value").alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One file, or one per range, in the order of lines."""
    lines.orderBy("line").select("text").write.mode("overwrite").text(path)


def _numbers(text: Column) -> Column:
    parts = F.split(F.trim(text), "\\s+")
    return F.filter(F.transform(parts, lambda p: p.try_cast("long")), lambda n: n.isNotNull())


def _joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), " ")


def encode_cells(dictionary: DataFrame) -> DataFrame:
    text = F.concat(F.lit("("), F.col("x"), F.lit(", "), F.col("y"), F.lit(", "), F.col("t"), F.lit(")"))
    return dictionary.select(F.col("item_id").alias("line"), text.alias("text"))


def decode_cells(lines: DataFrame) -> DataFrame:
    part = lambda n: F.regexp_extract("text", r"\(\s*(-?\d+),\s*(-?\d+),\s*(-?\d+)\s*\)", n).try_cast("long")
    made = lines.select(F.col("line").alias("item_id"), part(1).alias("x"), part(2).alias("y"), part(3).alias("t"))
    return made.filter(F.col("x").isNotNull())


def encode_enumerated(enumerated: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list("item_id"))
    return enumerated.groupBy(F.col("trajectory_idx").alias("line")).agg(_joined(items).alias("text"))


def decode_enumerated(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("line").alias("trajectory_idx"), F.explode(_numbers(F.col("text"))).alias("item_id")).distinct()


def encode_itemsets(itemsets: DataFrame) -> DataFrame:
    text = F.concat(_joined(F.col("items")), F.lit(" ("), F.col("support").cast("string"), F.lit(")"))
    return itemsets.select(F.col("itemset_id").alias("line"), text.alias("text"))


def decode_itemsets(lines: DataFrame, min_length: int = 0) -> DataFrame:
    """Ids are line numbers and are given before short itemsets are left out."""
    support = F.regexp_extract("text", r"\((\d+)\)", 1).try_cast("long")
    items = F.array_sort(_numbers(F.regexp_replace("text", r"\(.*$", "")))
    made = lines.select(F.col("line").alias("itemset_id"), items.alias("items"), F.size(items).cast("long").alias("n_items"), support.alias("support"))
    return made.filter(F.col("support").isNotNull() & (F.col("n_items") >= min_length))


def encode_cliques(cliques: DataFrame) -> DataFrame:
    members = F.array_sort(F.collect_list("trajectory_idx"))
    grouped = cliques.groupBy(F.col("itemset_id").alias("line")).agg(members.alias("m"))
    return grouped.select("line", F.concat(F.col("line").cast("string"), F.lit(": "), _joined(F.col("m"))).alias("text"))


def decode_cliques(lines: DataFrame) -> DataFrame:
    head = F.trim(F.substring_index("text", ":", 1)).try_cast("long")
    rest = F.when(F.instr("text", ":") > 0, F.expr("substring(text, instr(text, ':') + 1)"))
    made = lines.select(head.alias("itemset_id"), F.explode(_numbers(rest)).alias("trajectory_idx"))
    return made.filter(F.col("itemset_id").isNotNull())


def encode_groups(groups: DataFrame) -> DataFrame:
    members = F.array_sort(F.collect_list("trajectory_idx"))
    return groups.groupBy(F.col("group_id").alias("line")).agg(_joined(members).alias("text"))


def decode_groups(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("line").alias("group_id"), F.explode(_numbers(F.col("text"))).alias("trajectory_idx"))


def decode_transactions(lines: DataFrame) -> DataFrame:
    """line, items of the lines that hold any number."""
    made = lines.select("line", F.array_distinct(_numbers(F.col("text"))).alias("items"))
    return made.filter(F.size("items") > 0)


def encode_points(samples: DataFrame) -> DataFrame:
    """``id,t,x,y`` lines in order of id, time and place in the path."""
    ids = rank_keys(samples, ["trajectory_id", "t", "seq"], "line")
    text = F.concat_ws(",", "trajectory_id", "t", "x", "y")
    return samples.join(ids, ["trajectory_id", "t", "seq"]).select("line", text.alias("text"))


def decode_points(lines: DataFrame) -> DataFrame:
    """trajectory_id, ord, x, y, t from ``id,t,x,y[,ignored]``; # begins a comment line."""
    parts = F.split("text", ",")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    rows = lines.filter(~F.col("text").rlike(r"^\s*#"))
    made = rows.select(part(0).alias("trajectory_id"), F.col("line").alias("ord"), part(2).alias("x"), part(3).alias("y"), part(1).alias("t"))
    return made.filter(F.col("trajectory_id").isNotNull())


def decode_lists(lines: DataFrame) -> DataFrame:
    """line, pos, value of lists of comma-separated values."""
    return lines.filter(F.trim("text") != "").select("line", F.posexplode(F.transform(F.split("text", ","), lambda v: F.trim(v))).alias("pos", "value"))


def encode_stats(stats: DataFrame) -> DataFrame:
    """``label: value`` lines from columns line, label, value."""
    return stats.select("line", F.concat(F.col("label"), F.lit(": "), F.col("value").cast("string")).alias("text"))
