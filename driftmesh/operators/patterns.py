"""Closed and maximal itemsets, mined directly.

A search begins at each frequent item, in the table of the baskets that hold it, and
adds items that come later in the order (rarest first). An item that all baskets of a
table hold belongs to every set in it; if such an item comes before the one that the
search began or went on with, the same sets are found from there, and the branch is
left. So every closed set is made once, from one other closed set, and no list of all
frequent sets is needed. For maximal sets a branch is not opened if its head and whole
tail lie in a set already found, and is replaced by that one set if it is frequent.

Tables keep the items before the search's own, so that each one tells on its own which
sets are closed or maximal. They are dealt by the items they begin with and mined in
their tasks; a table of more baskets than a task should hold is counted as a whole and
dealt again by one more item, as often as it takes. Equal baskets are one with a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.storage import materialize

#: Distinct baskets of a table that one task mines.
LIMIT = 100_000
MAX_ROUNDS = 1000
ITEM = "struct<support:bigint,item:bigint>"
FOUND = pa.schema([("items", pa.list_(pa.int64())), ("support", pa.int64())])


class Table:
    """Weighted baskets of item codes, one after the other."""

    def __init__(self, items: np.ndarray, lengths: np.ndarray, weights: np.ndarray, n: int):
        self.items, self.lengths, self.weights, self.n = items, lengths, weights, n
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        self.total = int(weights.sum())
        self.rows = np.repeat(np.arange(len(lengths)), lengths)
        self._order: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        """In how much weight each item is."""
        return np.bincount(self.items, self.weights[self.rows], self.n).astype(np.int64)

    def holders(self, item: int) -> np.ndarray:
        """The baskets with an item."""
        if self._order is None:
            self._order = np.argsort(self.items, kind="stable")
            self._sorted = self.items[self._order]
        low, high = np.searchsorted(self._sorted, [item, item + 1])
        return self.rows[self._order[low:high]]

    def take(self, rows: np.ndarray, keep: np.ndarray) -> Table:
        """Some of the baskets, less the items that are not to be kept."""
        lengths = self.lengths[rows]
        at = np.repeat(self.begins[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(rows) else np.zeros(0, np.int64)
        items = self.items[at]
        kept = keep[items]
        own = np.repeat(np.arange(len(rows)), lengths)[kept]
        return Table(items[kept], np.bincount(own, minlength=len(rows)), self.weights[rows], self.n)


@dataclass
class Miner:
    """The sets of one table that hold all of ``have`` and go on with items after ``core``."""

    table: Table
    core: int
    have: np.ndarray
    least: int
    #: tables that were counted
    opened: int = 0
    #: frequent sets, as bits of their codes, whose subsets need no search
    known: list[int] = field(default_factory=list)

    def closed(self) -> Iterator[tuple[np.ndarray, int]]:
        return self._search(self._open_closed)

    def maximal(self) -> Iterator[tuple[np.ndarray, int]]:
        return self._search(self._open_maximal)

    def _search(self, visit: Callable) -> Iterator[tuple[np.ndarray, int]]:
        """Depth first; a frame is a table, its set, the items worth keeping and those to go on with."""
        frames = [iter([(self.table, self.core, self.have)])]
        while frames:
            child = next(frames[-1], None)
            if child is None:
                frames.pop()
                continue
            self.opened += 1
            found, branches = visit(*child)
            yield from found
            frames.append(branches)

    def _counted(self, table: Table, core: int, have: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The set with what all its baskets hold, and the frequent items besides with their counts; None if found elsewhere."""
        counts = table.counts()
        whole = (counts == table.total) & ~have
        if whole[:core].any():
            return None
        return have | whole, (counts >= self.least) & ~have & ~whole, counts

    def _branches(self, table: Table, have: np.ndarray, frequent: np.ndarray, tail: np.ndarray, wanted: Callable[[int], bool]) -> Iterator[tuple]:
        for item in tail:
            if wanted(item):
                keep, more = frequent.copy(), have.copy()
                keep[item], more[item] = False, True
                yield table.take(table.holders(item), keep), int(item), more

    def _open_closed(self, table: Table, core: int, have: np.ndarray):
        counted = self._counted(table, core, have)
        if counted is None:
            return [], iter(())
        have, frequent, _ = counted
        tail = np.flatnonzero(frequent[core + 1 :]) + core + 1
        return [(have, table.total)], self._branches(table, have, frequent, tail, lambda item: True)

    def _open_maximal(self, table: Table, core: int, have: np.ndarray):
        counted = self._counted(table, core, have)
        if counted is None:
            return [], iter(())
        have, frequent, _ = counted
        if not frequent.any():
            self.known.append(_bits(have))
            return [(have, table.total)], iter(())
        tail = np.flatnonzero(frequent[core + 1 :]) + core + 1
        if not len(tail):  # an item before the core would make it larger
            self.known.append(_bits(have))
            return [], iter(())
        in_tail = np.zeros(table.n, bool)
        in_tail[tail] = True
        full = np.flatnonzero(np.bincount(table.rows[in_tail[table.items]], minlength=len(table.lengths)) == len(tail))
        weight = int(table.weights[full].sum())
        if weight >= self.least:  # head and tail together are frequent, so no other set of the branch is maximal
            self.known.append(_bits(have | in_tail))
            larger = table.take(full, frequent & ~in_tail).counts() >= self.least
            return ([] if larger.any() else [(have | in_tail, weight)]), iter(())

        def wanted(item: int) -> bool:
            rest = in_tail.copy()
            rest[:item] = False
            bound = _bits(have | rest)
            return not any(bound & ~k == 0 for k in self.known)

        return [], self._branches(table, have, frequent, tail, wanted)


def _bits(codes: np.ndarray) -> int:
    return int.from_bytes(np.packbits(codes).tobytes(), "big")


def _decoded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, supports and items of a column of lists of items."""
    lists = column.combine_chunks()
    flat = lists.flatten()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, flat.field("support").to_numpy(), flat.field("item").to_numpy()


def miner_of(table: pa.Table, least: int) -> tuple[Miner, np.ndarray]:
    """The search of a table (have, items, weight), and the items that its codes stand for."""
    begun = table["have"][0].as_py()
    lengths, supports, items = _decoded(table["items"])
    known = np.array([(b["support"], b["item"]) for b in begun], np.int64)
    names, at = np.unique(np.concatenate([items, known[:, 1]]), return_index=True)
    order = np.lexsort((names, np.concatenate([supports, known[:, 0]])[at]))  # rarest first
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    have = np.zeros(len(names), bool)
    have[code[np.searchsorted(names, known[:, 1])]] = True
    baskets = Table(code[np.searchsorted(names, items)], lengths, table["weight"].to_numpy(), len(names))
    core = int(code[np.searchsorted(names, begun[-1]["item"])])
    return Miner(baskets, core, have, least), names[order]


def _weighted(baskets: DataFrame, least: int, items: str) -> tuple[DataFrame, list[int], int]:
    """Distinct baskets of frequent items (items, weight), the items of all baskets, and the number of baskets."""
    filled = baskets.filter(F.size(items) > 0).select(F.monotonically_increasing_id().alias("basket"), F.array_distinct(items).alias("items"))
    filled = materialize(filled, "baskets")
    n = filled.count()
    visits = filled.select("basket", F.explode("items").alias("item"))
    support = materialize(visits.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least), "support")
    universal = [r["item"] for r in support.filter(F.col("support") == n).select("item").collect()]  # no more than the shortest basket holds
    entry = F.struct("support", F.col("item").cast("long").alias("item"))
    ordered = visits.join(support.filter(F.col("support") < n), "item").groupBy("basket").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return ordered.groupBy("items").agg(F.count("*").alias("weight")), universal, n


def _dealt(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of tables that a task mines, and of larger ones."""
    made = materialize(rows, "tables")
    return made.filter(F.col("size") <= limit), made.filter(F.col("size") > limit)


def _mined(rows: DataFrame, least: int, kind: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        miner, names = miner_of(table, least)
        found = [(names[codes].tolist(), support) for codes, support in getattr(miner, kind)()]
        return pa.table({"items": pa.array([f[0] for f in found], FOUND.field(0).type), "support": pa.array([f[1] for f in found], pa.int64())})

    return rows.select("have", "items", "weight").groupBy("have").applyInArrow(run, "items array<bigint>, support bigint")


def _opened(rows: DataFrame, least: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """What large tables give themselves, and the tables of their branches; counted, as a whole, by table and item."""
    totals = rows.groupBy("have").agg(F.sum("weight").alias("total"))
    each = rows.select("have", F.explode("items").alias("e"), "weight").groupBy("have", "e").agg(F.sum("weight").alias("s"), F.count("*").alias("size"))
    whole = F.collect_list(F.when(F.col("s") == F.col("total"), F.col("e"))).alias("whole")
    frequent = F.collect_list(F.when((F.col("s") >= least) & (F.col("s") < F.col("total")), F.struct("e", "size"))).alias("frequent")
    info = totals.join(each, "have", "left").groupBy("have", "total").agg(whole, frequent)
    core = F.element_at("have", -1)
    info = materialize(info.filter(~F.exists("whole", lambda e: e < core)).withColumn("full", F.concat("have", "whole")), "opened")
    found = info if kind == "closed" else info.filter(F.size("frequent") == 0)
    named = found.select(F.transform("full", lambda e: e["item"]).alias("items"), F.col("total").alias("support"))
    later = F.filter("frequent", lambda f: f["e"] > core)
    branches = info.select(F.col("have").alias("parent"), "full", "whole", F.explode(later).alias("f")).select("parent", "full", "whole", F.col("f.e").alias("e"), F.col("f.size").alias("size"))
    spread = rows.select(F.col("have").alias("parent"), "items", "weight", F.explode("items").alias("e"))
    own = F.array(F.col("e"))
    rest = F.array_except("items", F.concat("whole", own))
    return named, spread.join(branches, ["parent", "e"]).select(F.concat("full", own).alias("have"), rest.alias("items"), "weight", "size")


def _mine(baskets: DataFrame, min_support: int, kind: str, items: str, limit: int) -> DataFrame:
    if min_support < 0:
        raise ValueError("min_support must not be negative")
    least = max(1, min_support)
    weighted, universal, n = _weighted(baskets, least, items)
    weighted = materialize(weighted, "weighted-baskets")
    spread = weighted.select("items", "weight", F.explode("items").alias("e"))
    rows = spread.select(F.array("e").alias("have"), F.array_except("items", F.array("e")).alias("items"), "weight", F.col("e.support").alias("size"))
    found = []
    for _ in range(MAX_ROUNDS):
        small, large = _dealt(rows, limit)
        found.append(_mined(small, least, kind))
        if large.isEmpty():
            break
        made, rows = _opened(large, least, kind)
        found.append(made)
    else:
        raise RuntimeError(f"tables are still too large after {MAX_ROUNDS} rounds")
    shared = F.array(*[F.lit(u).cast("long") for u in universal]).cast("array<bigint>")
    sets = found[0]
    for part in found[1:]:
        sets = sets.unionAll(part)
    sets = sets.select(F.array_sort(F.concat("items", shared)).alias("items"), "support")
    if universal and n >= least and (kind == "closed" or weighted.isEmpty()):
        alone = baskets.sparkSession.range(1).select(F.array_sort(shared).alias("items"), F.lit(n).cast("long").alias("support"))
        sets = sets.unionAll(alone)
    return materialize(sets, f"{kind}-itemsets")


def closed_itemsets(baskets: DataFrame, min_support: int, items: str = "items", limit: int = LIMIT) -> DataFrame:
    """items (sorted), support of the sets in enough baskets that no larger one has the support of.

    ``min_support`` is a count; 0 counts as 1 and negative numbers raise. Empty baskets
    are none, and an item counts once in a basket. ``limit`` bounds the baskets of a table
    that one task mines, not the result.
    """
    return _mine(baskets, min_support, "closed", items, limit)


def maximal_itemsets(baskets: DataFrame, min_support: int, items: str = "items", limit: int = LIMIT) -> DataFrame:
    """items (sorted), support of the sets in enough baskets that no larger one in enough baskets holds; else as ``closed_itemsets``."""
    return _mine(baskets, min_support, "maximal", items, limit)
