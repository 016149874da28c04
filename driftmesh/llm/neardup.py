"""SimHash near-dedup: fingerprints, their neighbours, and the groups they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.fingerprints import fingerprints
from driftmesh.llm.vptree import near_links
from driftmesh.operators.components import component_labels
from driftmesh.storage import materialize


def near_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (long), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest id reachable over links. Equal fingerprints are
    one node, so copies cost one row each and no pairs. Null and empty texts share
    fingerprint 0 and are linked to each other like any others; null ids are never
    the smallest unless a group has no other; repeated rows stay.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col).select(F.col(id_col).alias("id"), "fingerprint"), "fingerprints")
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    nodes = materialize(nodes, "fingerprint-nodes")
    labels = component_labels(near_links(nodes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = nodes.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    groups = named.groupBy("label").agg(F.min("first").alias("component_id"))
    chosen = named.join(groups, "label").select("fingerprint", "component_id")
    return prints.join(chosen, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group: one document of each group.

    Rows with a null id stay, as they cannot be told apart. Rows that repeat an id
    are one document, of which one row stays.
    """
    return one_of_each(docs, near_groups(docs, radius, shingle, id_col, text_col), id_col)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As ``keep_one``, with the groups given: id and component_id of every row."""
    groups = materialize(groups, "near-groups")
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(materialize(gone, "near-copies"), id_col, "left_anti").select(docs.columns)
    if groups.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty():
        return kept
    # of rows that repeat an id the first one in order of all columns stays, on every run alike
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(row).alias("__row")).select(*[F.col("__row")[c].alias(c) for c in docs.columns])
    return once.unionAll(kept.filter(F.col(id_col).isNull()))
