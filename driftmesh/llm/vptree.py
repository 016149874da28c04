"""Exact Hamming neighbours of 64-bit fingerprints with vantage-point trees.

Over whole words of unrelated texts all distances lie around 32, and a radius of a
few bits is as wide as their spread: triangle bounds would prune next to nothing.
So the word is seen through a few views, disjoint blocks of bits. A pair within
``radius`` bits has at most as many differing bits in one view as that view allows:
one, or none (for radius 4: two views of 23 bits that allow one, and one of 18 that
allows none). Each view has a vantage-point tree over the distance in its block.

A node has a vantage point, one of its fingerprints, and a child for each distance
to it. The triangle inequality confines the neighbours of x at distance one to the
shells d(x, v) - 1 and d(x, v) + 1, and as one changed bit moves every distance by
exactly one, the shell d(x, v) itself holds only those with an equal block. A
fingerprint thus lives in one leaf, and visits leaves on the other side of shell
borders: of two neighbours the one in the lower shell of the first node visits the
other, so each pair meets once. All other branches are pruned.

The upper levels are grown on a bounded sample and broadcast; they deal the
fingerprints to shards. There the tree grows on, on the shard's own fingerprints,
until leaves are small or hold one block value. The sample decides how large
leaves are, never what is found. A leaf with too many rows is split into parts, and
each pair of parts is a shard. Full fingerprints are compared exactly, and a shard
emits the links of a spanning forest of what it found instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.arrow import map_batches
from driftmesh.storage import materialize

WORD = 64
#: Rows that a shard gets on average, and a leaf at most before it is split.
SHARD_ROWS = 20_000
#: Fingerprints that the upper levels are grown on at most.
SAMPLE = 16_384
#: Fingerprints that a leaf keeps.
LEAF_ROWS = 16
#: Candidate pairs compared at once.
PAIRS = 2_000_000


class View(NamedTuple):
    """A block of bits, and how many of them neighbours may differ in."""

    shift: int
    bits: int
    radius: int

    def of(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1)


def views(radius: int) -> list[View]:
    """Views of which one at least is kept to by any pair within ``radius`` bits.

    A pair that exceeds every view differs in the sum of (allowed + 1) bits at least.
    """
    n = (radius + 2) // 2
    allowed = [1] * n
    if radius % 2 == 0:
        allowed[-1] = 0
    narrow = WORD // n - 3 if radius % 2 == 0 and n > 1 else WORD // n
    wide = [(WORD - narrow) // (n - 1) + (k < (WORD - narrow) % (n - 1)) for k in range(n - 1)] if n > 1 else []
    sizes = [*wide, narrow]
    return [View(sum(sizes[:k]), size, allowed[k]) for k, size in enumerate(sizes)]


class ShellTree:
    """Vantage points grown on some block values, level by level for all nodes at once.

    ``start`` names the node every value begins in, from 0. A node splits while it has
    more than ``leaf_rows`` values and not all are equal.
    """

    def __init__(self, values: np.ndarray, start: np.ndarray, n_start: int, bits: int, leaf_rows: int):
        self.width = bits + 1
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        offset = n_start
        while len(values):
            nodes, first, at, count = np.unique(start, return_index=True, return_inverse=True, return_counts=True)
            vantage = values[first]
            split = (count > leaf_rows) & (np.bincount(at, values != vantage[at]) > 0)
            if not split.any():
                break
            self.levels.append((nodes[split], vantage[split], offset))
            inside = split[at]
            place = (np.cumsum(split) - 1)[at[inside]]
            values = values[inside]
            start = offset + place * self.width + self._distance(values, vantage[split][place])
            offset += int(split.sum()) * self.width
        self.n_nodes = offset

    @staticmethod
    def _distance(values: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.bitwise_count(values ^ vantage).astype(np.int64)

    def _step(self, level: tuple[np.ndarray, np.ndarray, int], values: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows stand in a node that splits here, their first child, and their shell."""
        nodes, vantage, offset = level
        at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
        inside = nodes[at] == node
        at = at[inside]
        return inside, offset + at * self.width, self._distance(values[inside], vantage[at])

    def home(self, values: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaf that each value lives in."""
        node = node.copy()
        for level in self.levels:
            inside, child, shell = self._step(level, values, node)
            node[inside] = child + shell
        return node

    def visits(self, values: np.ndarray, node: np.ndarray, upward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that may hold a value one bit away.

        With ``upward``, the values live in this tree: the first step goes to the upper
        shell only, and a node that does not split is not visited.
        """
        row, done_row, done_leaf = np.arange(len(values)), [], []
        if upward and not self.levels:
            return row[:0], node[:0]
        for number, level in enumerate(self.levels):
            inside, child, shell = self._step(level, values[row], node)
            if not (upward and number == 0):
                done_row.append(row[~inside])
                done_leaf.append(node[~inside])
            row = row[inside]
            steps = (1,) if upward and number == 0 else (-1, 1)
            allowed = [(shell + s >= 0) & (shell + s < self.width) for s in steps]
            node = np.concatenate([(child + shell + s)[ok] for s, ok in zip(steps, allowed, strict=True)])
            row = np.concatenate([row[ok] for ok in allowed])
        return np.concatenate([*done_row, row]), np.concatenate([*done_leaf, node])


def _deal(batch: pa.RecordBatch, trees: list[tuple[View, ShellTree]]) -> dict:
    """Every fingerprint to its own leaf of each view and to those it has to visit."""
    prints = batch.column("fingerprint").to_numpy().view(np.uint64)
    root = np.zeros(len(prints), np.int64)
    number, leaves, rows, homes = [], [], [], []
    for k, (view, tree) in enumerate(trees):
        values = view.of(prints)
        found = [(np.arange(len(prints)), tree.home(values, root))]
        if view.radius:
            found.append(tree.visits(values, root, upward=True))
        for home, (row, leaf) in zip((True, False), found, strict=False):
            number.append(np.full(len(row), k, np.int32))
            leaves.append(leaf)
            rows.append(row)
            homes.append(np.full(len(row), home))
    return {"view": np.concatenate(number), "leaf": np.concatenate(leaves), "fingerprint": prints.view(np.int64)[np.concatenate(rows)], "home": np.concatenate(homes)}


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a and b: every label is the smallest of its class."""
    while len(a):
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        differ = low != high
        a, b = a[differ], b[differ]
        np.minimum.at(labels, high[differ], low[differ])
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
    return labels


def _meetings(leaf: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that meet in a leaf, some at a time; rows sorted by leaf, homes first."""
    first = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(leaf)))
    n_home = np.add.reduceat(home.astype(np.int64), first) if len(first) else first
    # each row meets the home rows of its leaf that stand before it
    before = np.repeat(first, size)
    meets = np.minimum(np.arange(len(leaf)) - before, np.repeat(n_home, size))
    ends = np.cumsum(meets)
    start = 0
    while start < len(leaf):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        n = meets[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(before[start:stop], n)
        yield left, right
        start = stop


def fine_leaves(prints: np.ndarray, start: np.ndarray, home: np.ndarray, view: View, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): where the rows of some leaves stand once those have grown on."""
    start = np.unique(start, return_inverse=True)[1].astype(np.int64)
    values, own, others = view.of(prints), np.flatnonzero(home), np.flatnonzero(~home)
    tree = ShellTree(values[own], start[own], int(start.max(initial=-1)) + 1, view.bits, leaf_rows)
    rows, leaves = [own], [tree.home(values[own], start[own])]
    if view.radius:
        for which, upward in ((own, True), (others, False)):
            row, leaf = tree.visits(values[which], start[which], upward)
            rows.append(which[row])
            leaves.append(leaf)
    at_home = np.arange(sum(map(len, rows))) < len(own)
    return np.concatenate(rows), np.concatenate(leaves), at_home


def shard_links(view: np.ndarray, leaf: np.ndarray, prints: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (from, to) that connect whatever lies within ``radius`` in a shared leaf, and the pairs compared."""
    known, number = np.unique(prints, return_inverse=True)
    labels, compared = np.arange(len(known)), 0
    for k, kept_to in enumerate(views(radius)):
        here = np.flatnonzero(view == k)
        row, fine, at_home = fine_leaves(prints[here], leaf[here], home[here], kept_to)
        order = np.lexsort((~at_home, fine))
        row = here[row[order]]
        for left, right in _meetings(fine[order], at_home[order]):
            left, right = row[left], row[right]
            compared += len(left)
            near = np.bitwise_count(prints[left] ^ prints[right]) <= radius
            labels = _roots(labels, number[left[near]], number[right[near]])
    linked = np.flatnonzero(labels != np.arange(len(known)))
    return known[linked], known[labels[linked]], compared


def _upper_trees(prints: DataFrame, radius: int, n_prints: int, shard_rows: int, sample: int) -> list[tuple[View, ShellTree]]:
    rows = prints.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample).collect()
    values = np.array([r["fingerprint"] for r in rows], np.int64).view(np.uint64)
    leaf_rows = max(LEAF_ROWS, len(values) * shard_rows // max(n_prints, 1))
    return [(v, ShellTree(v.of(values), np.zeros(len(values), np.int64), 1, v.bits, leaf_rows)) for v in views(radius)]


def near_links(prints: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """src, dst: links whose components are those of all pairs within ``radius`` bits.

    ``prints`` has distinct values in column fingerprint. The links found in a
    shard form a forest: at most one per fingerprint and shard. ``sample`` bounds the
    fingerprints that the upper levels are grown on; all are searched.
    """
    n_prints = prints.count()
    trees = prints.sparkSession.sparkContext.broadcast(_upper_trees(prints, radius, n_prints, shard_rows, sample))
    dealt = map_batches(prints, lambda batch: _deal(batch, trees.value), "view int, leaf long, fingerprint long, home boolean")
    sizes = materialize(dealt.groupBy("view", "leaf").count(), "leaf-sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    n_shards = max(1, round(total / shard_rows))
    # hot leaves: every row joins one part, and a shard has two parts
    hot = sizes.filter(F.col("count") > 2 * shard_rows).select("view", "leaf", F.ceil(F.col("count") / shard_rows).alias("parts"))
    hot = materialize(hot, "hot-leaves")
    part = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    meeting = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.least(part, other) * F.col("parts") + F.greatest(part, other))
    block = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meeting)).alias("block")
    split = dealt.join(hot, ["view", "leaf"], "left").select("view", "leaf", "fingerprint", "home", block)
    name = F.xxhash64("leaf", "block")
    sharded = split.select(F.pmod(F.xxhash64("view", "leaf", "block"), F.lit(n_shards)).alias("shard"), "view", name.alias("leaf"), "fingerprint", "home")

    def compare(table: pa.Table) -> pa.Table:
        view, leaf, fingerprint, home = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("view", "leaf", "fingerprint", "home"))
        src, dst, _ = shard_links(view, leaf, fingerprint.view(np.uint64), home.astype(bool), radius)
        return pa.table({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return sharded.groupBy("shard").applyInArrow(compare, "src long, dst long")
