"""From raw documents to a training mix in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives a
DataFrame that is written as Parquet and read again as the next one's documents.
All but the last return the columns of ``documents``.

Null and empty texts fail the first stage. Rows with a null id pass line dedup and near
dedup as they are, go if their own text holds a benchmark window, and share one draw of
the mix. Of rows that repeat an id one stays after near dedup, the first in order of all
columns. Long texts are read whole. Columns with names that a stage uses are kept
(``kept``) or replaced by the mix (``size``, ``copies``, ``copy`` and the others that it
adds). Empty tables give an empty result, and reruns agree.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm import contamination, lines, mixing, neardup, quality, shingles
from driftmesh.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's band go.

    Bands are fitted to the labelled ones among the documents. Null texts go.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    bands = quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), path)
    judged = quality.quality_rules(docs, path, bands, keep_columns=True)
    return judged.filter("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one of them; n_chars follows the text."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Near copies share 0.8 or more of their five-word shingles (Jaccard). SimHash
    fingerprints within four bits link most of them, checked exactly; a prefix-filtered
    join finds the rest.
    """
    return neardup.one_of_each(docs, shingles.similar_groups(docs, similarity=0.8, size=5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the columns of the mix and copy."""
    return mixing.emit_copies(mixing.mix(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The tokeniser bands and the near copies have no SQL form; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
