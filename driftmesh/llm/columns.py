"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs without blanks; null counts as no words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def key128(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: the text seeds nothing, a tag seeds the second."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second half"), text)]


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Columns of ``df`` followed by ``new``; a clashing name is replaced."""
    taken = {name.lower() for name in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[col.alias(name) for name, col in new.items()])
