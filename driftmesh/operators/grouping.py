"""Groups of trajectories from cliques: six strategies and the largest groups.

Strategies that only need connectivity run as distributed components. The others
depend on the order of merges (see ``agglomerate``), but only within a component: cliques
that share no member, directly or over others, never merge, whatever the threshold. Each
component is merged in a task of its own, for each threshold. Only values looked up by
position need the whole list, as a place in it moves with every merge anywhere.

A merged group is named by the first of the two, so group_id is the itemset_id of the
clique that it grew from.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators import agglomerate
from driftmesh.operators.cliques import connections, path_sizes, share, weight_last, weight_max
from driftmesh.operators.components import connected_components
from driftmesh.operators.ranking import rank_keys
from driftmesh.storage import materialize

GROUPS = "group_id long, trajectory_idx long"


def group_cc(cliques: DataFrame) -> DataFrame:
    """group_id, trajectory_idx: cliques that share members, as one group.

    Each member is linked to the smallest of its clique, a star instead of all
    pairs. A clique of one that meets no other stays a group. The group is named by
    its smallest member.
    """
    return linked_groups(star_edges(cliques))


def star_edges(cliques: DataFrame) -> DataFrame:
    """src, dst: the members of each clique and its smallest one, itself included."""
    centres = cliques.groupBy("itemset_id").agg(F.min("trajectory_idx").alias("dst"))
    return cliques.join(centres, "itemset_id").select(F.col("trajectory_idx").alias("src"), "dst").distinct()


def linked_groups(edges: DataFrame) -> DataFrame:
    """group_id, trajectory_idx: the components of ``star_edges``, also those of one member."""
    linked = connected_components(edges).toDF("trajectory_idx", "group_id")
    members = edges.select(F.col("src").alias("trajectory_idx")).distinct()
    return members.join(linked, "trajectory_idx", "left").select(F.coalesce("group_id", "trajectory_idx").alias("group_id"), "trajectory_idx")


def clique_groups(cliques: DataFrame) -> DataFrame:
    """group_id, trajectory_idx: every clique as a group, numbered in order of itemsets."""
    return cliques.join(rank_keys(cliques, ["itemset_id"], "group_id"), "itemset_id").select("group_id", "trajectory_idx")


def group_overlap(edges: DataFrame) -> DataFrame:
    """Components of weighted edges (t1, t2, w) with w > 0; no group of one."""
    strong = edges.filter((F.col("w") > 0) & (F.col("t1") != F.col("t2"))).select(F.col("t1").alias("src"), F.col("t2").alias("dst"))
    return connected_components(strong).select(F.col("component").alias("group_id"), F.col("node").alias("trajectory_idx"))


def overlap_stars(members: DataFrame, enumerated: DataFrame, above: float) -> DataFrame:
    """t1, t2, w > ``above``: the members of each clique with the one of fewest cells, which give the components of all its pairs.

    ``members``: itemset_id, n_items, trajectory_idx. Under one clique a pair weighs the
    more the fewer cells it has, so of a pair that weighs enough each does so with the
    clique's smallest member too. Rows are no more than members, not pairs.
    """
    sized = members.join(path_sizes(enumerated).withColumnRenamed("n", "n1"), "trajectory_idx")
    hubs = sized.groupBy("itemset_id").agg(F.min(F.struct("n1", "trajectory_idx")).alias("hub"))
    stars = sized.join(hubs, "itemset_id").select(F.col("trajectory_idx").alias("t1"), F.col("hub.trajectory_idx").alias("t2"), "n_items", "n1", F.col("hub.n1").alias("n2"))
    return stars.select("t1", "t2", share(F.col("n_items")).alias("w")).filter((F.col("w") > above) & (F.col("t1") != F.col("t2")))


def _components(cliques: DataFrame, whole: bool = False) -> DataFrame:
    """trajectory_idx, component of all members; a single component if the whole list is needed."""
    if whole:
        return cliques.select("trajectory_idx").distinct().withColumn("component", F.lit(0).cast("long"))
    return materialize(group_cc(cliques).select("trajectory_idx", F.col("group_id").alias("component")), "clique-components")


def _merged(rows: DataFrame, thresholds: list[float], merge: Callable[[pd.DataFrame, float], list[tuple[int, list[int]]]]) -> DataFrame:
    """threshold, group_id, trajectory_idx: ``merge`` run for each threshold and component."""
    sets = rows.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), "*")  # every parameter set needs all rows

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        threshold = float(pdf["threshold"].iloc[0])
        made = [(threshold, name, m) for name, group in merge(pdf, threshold) for m in group]
        return pd.DataFrame(made, columns=["threshold", "group_id", "trajectory_idx"])

    return sets.groupBy("threshold", "component").applyInPandas(run, f"threshold double, {GROUPS}")


def _facts(components: DataFrame, cliques: DataFrame, edges: DataFrame | None = None, itemsets: DataFrame | None = None, attached: DataFrame | None = None) -> DataFrame:
    """Cliques (w: length), edges and attached groups as rows of one table: component, kind, a, b, w."""
    if itemsets is not None:
        cliques = cliques.join(itemsets.select("itemset_id", F.size("items").cast("double").alias("w")), "itemset_id")
    w = F.col("w") if itemsets is not None else F.lit(0.0)
    rows = cliques.join(components, "trajectory_idx").select("component", F.lit("clique").alias("kind"), F.col("itemset_id").alias("a"), F.col("trajectory_idx").alias("b"), w.alias("w"))
    if edges is not None:
        weight = F.col("w") if "w" in edges.columns else F.lit(1.0)
        placed = edges.join(components.withColumnRenamed("trajectory_idx", "t1"), "t1")
        rows = rows.unionAll(placed.select("component", F.lit("edge"), "t1", "t2", weight))
    if attached is not None:
        rows = rows.unionAll(attached.join(components, "trajectory_idx").select("component", F.lit("attached"), "group_id", "trajectory_idx", F.lit(0.0)))
    return rows


def _lists(pdf: pd.DataFrame, kind: str) -> tuple[list[int], list[list[int]]]:
    own = pdf[pdf["kind"] == kind]
    by_id = own.groupby("a")["b"].agg(sorted)
    return [int(i) for i in by_id.index], [[int(m) for m in c] for c in by_id]


def _edges(pdf: pd.DataFrame) -> dict[tuple[int, int], float]:
    own = pdf[pdf["kind"] == "edge"]
    return {(int(a), int(b)): float(w) for a, b, w in zip(own["a"], own["b"], own["w"], strict=True)}


def _lengths(pdf: pd.DataFrame) -> list[float]:
    own = pdf[pdf["kind"] == "clique"]
    return [float(w) for w in own.groupby("a")["w"].first()]


def _renamed(ids: list[int], groups: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    return [(ids[first], members) for first, members in groups]


def group_nc(cliques: DataFrame, thresholds: list[float]) -> DataFrame:
    """Cliques merged while all members connect to a share of the other side."""

    def merge(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, list[int]]]:
        ids, members = _lists(pdf, "clique")
        return _renamed(ids, agglomerate.Linkage(members, dict.fromkeys(_edges(pdf), 1.0), threshold).run())

    return _merged(_facts(_components(cliques), cliques, connections(cliques)), thresholds, merge)


def group_wc(cliques: DataFrame, itemsets: DataFrame, enumerated: DataFrame, thresholds: list[float]) -> DataFrame:
    """Cliques merged while all members' mean weight to the other side is enough."""

    def merge(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, list[int]]]:
        ids, members = _lists(pdf, "clique")
        return _renamed(ids, agglomerate.Linkage(members, _edges(pdf), threshold).run())

    return _merged(_facts(_components(cliques), cliques, weight_last(cliques, itemsets, enumerated)), thresholds, merge)


def group_attachment(cliques: DataFrame, itemsets: DataFrame, thresholds: list[float], index: str = "position") -> DataFrame:
    """Cliques merged while each side shares enough members with the other.

    With ``index="id"`` each component is merged on its own. ``position`` needs the whole
    list in one task, and so does a threshold of 0, at which all groups may merge.
    """

    def merge(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, list[int]]]:
        ids, members = _lists(pdf, "clique")
        return _renamed(ids, agglomerate.Attachment(members, _lengths(pdf), threshold, index).run())

    whole = index == "position" or min(thresholds) <= 0
    return _merged(_facts(_components(cliques, whole), cliques, itemsets=itemsets), thresholds, merge)


def group_both(cliques: DataFrame, itemsets: DataFrame, enumerated: DataFrame, overlap: float, attach: float, edge_mode: str = "directed", index: str = "position") -> DataFrame:
    """group_id, trajectory_idx: overlap edges and attachment groups together.

    ``directed`` reads an attachment group's edges only from its smaller to its
    larger members, and merges in list order, component by component; a group is named by
    the member that it grew from. ``symmetric`` takes components.
    """
    if edge_mode == "symmetric" and attach > 0:
        return tied_groups(star_edges(cliques))
    edges = weight_max(cliques, itemsets, enumerated, overlap)
    attached = group_attachment(cliques, itemsets, [attach], index)
    if edge_mode == "symmetric":
        hubs = attached.groupBy("group_id").agg(F.min("trajectory_idx").alias("t2"))
        stars = attached.join(hubs, "group_id").select(F.col("trajectory_idx").alias("t1"), "t2", F.lit(1.0).alias("w"))
        return group_overlap(edges.unionAll(stars))
    if edge_mode != "directed":
        raise ValueError("edge_mode is directed or symmetric")

    def merge(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, list[int]]]:
        nodes = sorted({int(m) for m in pdf.loc[pdf["kind"] == "clique", "b"]})
        return agglomerate.DirectedMerger(nodes, set(_edges(pdf)), _lists(pdf, "attached")[1]).run()

    facts = _facts(_components(cliques, attach <= 0), cliques, edges, attached=attached)
    return _merged(facts, [attach], merge).drop("threshold")


def tied_groups(edges: DataFrame) -> DataFrame:
    """The groups of two or more by ``both`` in symmetric mode, from ``star_edges``.

    Attachment groups hold every clique, and above a threshold of 0 only those merge that
    share a member. Overlap edges lie in cliques. So both link just what cliques link,
    in whatever order groups were merged.
    """
    return group_overlap(edges.select(F.col("src").alias("t1"), F.col("dst").alias("t2"), F.lit(1.0).alias("w")))


def topk_groups(groups: DataFrame, k: int = 5) -> DataFrame:
    """group_id, n_members of the ``k`` largest groups, smaller ids first; all if k < 1."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n_members"))
    ordered = sizes.orderBy(F.desc("n_members"), "group_id")
    return ordered.limit(k) if k >= 1 else ordered


def choose_groups(known: DataFrame, supplied: DataFrame | None) -> DataFrame:
    """The supplied groups if there are any, else the known ones."""
    return known if supplied is None or supplied.isEmpty() else supplied


def merge_members(a: str, b: str):
    """The sorted union of two member arrays."""
    return F.array_sort(F.array_union(a, b))
