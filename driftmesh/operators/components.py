"""Connected components of an edge table by repeated contraction.

In each round every node joins the neighbour (or itself) that comes first in a
hashed order, one pointer jump shortens the chains, and the edges are renamed.
A hashed order makes the number of labels fall by a constant factor whatever the
shape of the graph, also on long paths; tables are written between rounds, so
neither the plan nor a lost executor's work grows with the rounds. Only joins and
combined aggregations are used: no node's neighbours are gathered anywhere. Once few
enough edges are left, one task settles them, which saves the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.storage import discard, materialize

MAX_ROUNDS = 64
#: Edges that one task settles, at most.
LAST_EDGES = 50_000


def _ordered(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), node).alias("rank"), node.alias("node"))


def _undirected(edges: DataFrame) -> DataFrame:
    loose = edges.filter(F.col("src") != F.col("dst"))
    return loose.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of a few edges is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches]
        src, dst = (np.concatenate([c[k] for c in columns] or [np.zeros(0, np.int64)]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        root, a, b = np.arange(len(nodes)), at[: len(src)], at[len(src) :]
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            if np.array_equal(low, high):
                break
            np.minimum.at(root, high, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
        yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[root]})

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def component_labels(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, label: nodes of ``edges`` (src, dst) share a label if connected.

    Loops and repeated edges are ignored, so a node without a neighbour is not in
    the result. The label is one of the component's nodes, not the smallest.
    """
    edges = materialize(_undirected(edges), "edges")
    labels: DataFrame | None = None
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        last = edges.schema["src"].dataType.simpleString() == "bigint" and edges.limit(LAST_EDGES + 1).count() <= LAST_EDGES
        if last:
            moved = materialize(_settled(edges), "moves")
            if labels is None:
                return moved.select("node", F.col("root").alias("label"))
            renamed = labels.join(moved.withColumnRenamed("node", "label"), "label", "left")
            return materialize(renamed.select("node", F.coalesce("root", "label").alias("label")), "labels")
        both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        nearest = both.groupBy("src").agg(F.min(_ordered(F.col("dst"), turn)).alias("best"))
        own = _ordered(F.col("src"), turn)
        step = nearest.select(F.col("src").alias("node"), F.least(own, F.col("best"))["node"].alias("to"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moved = materialize(step.join(jump, "to").select("node", "root"), "moves")
        if labels is None:
            labels = moved.select("node", F.col("root").alias("label"))
        else:
            renamed = labels.join(moved.withColumnRenamed("node", "label"), "label", "left")
            before, labels = labels, materialize(renamed.select("node", F.coalesce("root", "label").alias("label")), "labels")
            discard(before)
        left = moved.select(F.col("node").alias("src"), F.col("root").alias("a"))
        right = moved.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        renamed = edges.join(left, "src").join(right, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        before, edges = edges, materialize(_undirected(renamed), "edges")
        discard(before, *([moved] if turn else []))  # the first moves are the labels
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: as ``component_labels``, named by the smallest node."""
    labels = component_labels(edges)
    names = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(names, "label").select("node", "component")
