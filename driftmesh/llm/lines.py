"""Line dedup: lines that many documents share are dropped from all but one.

Lines are exploded, normalised and hashed to 128 bits; a hash found in enough
distinct documents is a repeated line; its positions are dropped everywhere but
in the largest document holding it, and texts are put together again by position.
Only hashes, ids and positions are shuffled until the last join, whose skew (a
line found in a third of the documents) adaptive execution splits, as the side
of the repeated lines has one row per hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.columns import BLANKS, ascii_lower, key128, with_columns
from driftmesh.storage import materialize


def line_keys(text: Column) -> Column:
    """The normalised lines: blanks stripped at both ends, A-Z lower-cased."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(BLANKS)))


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """One row per repeated line: h1, h2, keeper (the largest id holding it)."""
    keys = F.array_distinct(F.filter(line_keys(F.col(text_col)), lambda k: F.char_length(k) >= min_chars))
    h1, h2 = key128(F.col("key"))
    # the outer form, as the inner one makes the keys a second time to see whether there are any
    held = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode_outer(keys).alias("key")).filter(F.col("key").isNotNull())
    counted = held.select("id", h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text, n_lines (before) and n_dropped.

    Null and empty texts are one empty line and come back as an empty text. Rows
    with a null id hold no line and lose none. Rows that share an id are one
    document: their lines count once and are dropped alike. A clashing column
    name is replaced; an empty table gives an empty table. The work on a text is
    linear in its lines.
    """
    h1, h2 = key128(F.col("key"))
    # written, so that the join below deals both sides itself and can split a hot hash
    repeated = materialize(repeated_lines(docs, min_docs, min_chars, id_col, text_col), "repeated-lines")
    version = F.xxhash64(F.col(text_col))
    # the version is made before lines are exploded, or every line would carry the text to hash it
    placed = (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), version.alias("version"), line_keys(F.col(text_col)).alias("keys"))
        .select("id", "version", F.posexplode_outer("keys").alias("pos", "key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "version", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    dropped = (
        placed.join(repeated, ["h1", "h2"])
        .filter(F.col("id") < F.col("keeper"))
        .groupBy(F.col("id").alias("__id"), F.col("version").alias("__version"))
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    joined = docs.join(dropped, (F.col(id_col) == F.col("__id")) & (version == F.col("__version")), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    # bound to a variable, the lines are cut once, not again for every line that stays
    picked = F.transform(F.array(lines), lambda cut: F.array_join(F.transform(kept, lambda i: F.get(cut, i)), "\n"))
    text = F.when(F.col("__dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.get(picked, F.lit(0)))
    new = {
        text_col: text,
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"),
    }
    return with_columns(joined, new).drop("__id", "__version", "__dropped")
