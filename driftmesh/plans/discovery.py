"""The whole search for moving groups, with stages shared between parameters."""

from __future__ import annotations

import time
from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from driftmesh.model import Level
from driftmesh.operators import cells, cliques, grouping, mining, patterns
from driftmesh.operators.components import component_labels
from driftmesh.storage import materialize

#: Items of the longest sets that are grown for groups by overlap; closed sets that need more are mined.
GROWN = 8
#: One in so many cells is mined first where groups need no more than connections.
FIRST_OF = 4
#: One in so many trajectories may be outside the largest group for their sets to be looked up first.
FEW = 10
KINDS = {"closed": patterns.closed_itemsets, "maximal": patterns.maximal_itemsets}


class Discovery:
    """Stages from samples to groups, each built once per parameters and kept."""

    def __init__(self, samples: DataFrame):
        self.samples = samples
        self._made: dict[tuple, DataFrame] = {}
        self._frequent: dict[tuple, mining.Frequent] = {}
        self.seconds: dict[tuple, float] = {}
        #: rows of each stage and the characters of their values, counted as they were written
        self.metrics: dict[tuple, dict[str, int]] = {}

    def _stage(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._made:
            begin, made, seen = time.perf_counter(), make(), Observation()
            width = sum((F.length(F.col(c).cast("string")) for c in made.columns), F.lit(0))
            observed = made.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("chars"))
            self._made[key] = materialize(observed, str(key[0]))
            self.metrics[key] = seen.get
            self.seconds[key] = time.perf_counter() - begin
        return self._made[key]

    def stage_metrics(self) -> DataFrame:
        """stage, rows, chars of the stages made so far, in their order; counted by their own writing, not by another run."""
        rows = [(k, str(key[0]), m["rows"], m["chars"]) for k, (key, m) in enumerate(self.metrics.items())]
        return self.samples.sparkSession.createDataFrame(rows, "line long, stage string, rows long, chars long")

    def enumerated(self, level: Level) -> DataFrame:
        return self._stage(("enumerated", level), lambda: cells.enumerate_cells(cells.rollup_samples(self.samples, level)))

    def frequent(self, level: Level, min_support: int, max_length: int | None = None) -> mining.Frequent:
        """All frequent sets, with the trajectories that hold them; of ``max_length`` cells at most if given, or longer ones too if they are known."""
        key = self._known(level, min_support, max_length) or (level, min_support, max_length)
        if key not in self._frequent:
            self._frequent[key] = mining.frequent_sets(cells.baskets(self.enumerated(level)), min_support, key="trajectory_idx", max_length=max_length)
        return self._frequent[key]

    def _known(self, level: Level, min_support: int, max_length: int | None) -> tuple | None:
        """The key of frequent sets that are made already and hold those of ``max_length`` cells."""
        fitting = (k for k in self._frequent if max_length and k[:2] == (level, min_support) and (k[2] is None or k[2] >= max_length))
        return next(fitting, None)

    def itemsets(self, level: Level, min_support: int, kind: str = "closed") -> DataFrame:
        def make() -> DataFrame:
            if kind == "all":
                return mining.numbered(self.frequent(level, min_support).sets.select("items", "support"))
            return mining.numbered(KINDS[kind](cells.baskets(self.enumerated(level)), min_support))

        return self._stage(("itemsets", level, min_support, kind), make)

    def cliques(self, level: Level, min_support: int, min_length: int = 1, kind: str = "closed") -> DataFrame:
        sets = mining.at_least(self.itemsets(level, min_support, kind), min_length)

        def make() -> DataFrame:
            if kind == "all":
                return mining.frequent_cliques(self.frequent(level, min_support), sets)
            return cliques.match_cliques(sets, self.enumerated(level))

        return self._stage(("cliques", level, min_support, min_length, kind), make)

    def linked(self, level: Level, min_support: int, min_length: int = 1, kind: str = "closed") -> DataFrame:
        """group_id, trajectory_idx: the groups of cliques that share members, for which no longer sets are needed.

        Members of a longer set are all members of each set of ``min_length`` cells in it, and a
        frequent set of that many cells has the members of a closed set of as many or more. So
        the sets of just that length link the same trajectories, unless only maximal sets are asked for.
        """
        if kind == "maximal":
            return grouping.group_cc(self.cliques(level, min_support, min_length, kind))
        return grouping.linked_groups(self._links(level, min_support, min_length))

    def _links(self, level: Level, min_support: int, min_length: int) -> DataFrame:
        """src, dst that connect what the cliques of ``min_length`` cells do; every member is a src."""
        length = max(1, min_length)
        return self._stage(("links", level, min_support, length), lambda: self._spanning(level, min_support, length, length, grouping.star_edges))

    def _spanning(self, level: Level, min_support: int, min_length: int, max_length: int, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """src, dst with the components of ``edges`` of the ``members``, and all their nodes as src.

        Sets of some of the cells are mined first. What they connect to the largest group is
        connected, so another set tells something only if one outside holds it: those
        sets are mined then, with all that hold them. Where nearly all are one group, as on
        large tables, they are few; else all sets are made.
        """
        if max_length == 1 or self._known(level, min_support, max_length):
            return edges(self.members(level, min_support, min_length, max_length))
        visits = self.enumerated(level)

        def linked(part: DataFrame, held_by: DataFrame | None = None) -> DataFrame:
            made = mining.frequent_sets(cells.baskets(part), min_support, key="trajectory_idx", max_length=max_length, held_by=held_by)
            return edges(_members(made, min_length, max_length)).select("src", "dst")

        labels = materialize(component_labels(linked(visits.filter(F.pmod(F.xxhash64("item_id"), F.lit(FIRST_OF)) == 0))), "first-labels")
        largest = labels.groupBy("label").count().orderBy(F.desc("count"), "label").first()
        inside = labels.filter(F.col("label") == (largest["label"] if largest else None)).select(F.col("node").alias("trajectory_idx"))
        outside = materialize(visits.join(inside, "trajectory_idx", "left_anti"), "outside")
        keys = outside.select(F.col("trajectory_idx").alias("key")).distinct()
        few = keys.count() * FEW <= visits.select("trajectory_idx").distinct().count()
        rest = linked(visits.join(outside.select("item_id").distinct(), "item_id", "left_semi"), keys if few else None)
        return labels.select(F.col("node").alias("src"), F.col("label").alias("dst")).unionAll(rest)

    def members(self, level: Level, min_support: int, min_length: int = 1, max_length: int | None = None) -> DataFrame:
        """itemset_id, n_items, trajectory_idx: who holds each frequent set of those lengths; sets are named, not numbered in order."""
        return _members(self.frequent(level, min_support, max_length), min_length, max_length)

    def weights_to(self, level: Level, min_support: int, min_length: int, columns: list[int]) -> DataFrame:
        """t1, t2, w as by ``cliques.weights_to``; a set that one of ``columns`` holds has cells of theirs only, so no others are mined."""
        visits = self.enumerated(level)
        own = materialize(visits.filter(F.col("trajectory_idx").isin(columns)), "own-visits")
        met = visits.join(own.select("item_id").distinct(), "item_id", "left_semi")
        made = mining.frequent_sets(cells.baskets(met), min_support, key="trajectory_idx", held_by=own.select(F.col("trajectory_idx").alias("key")).distinct())
        each = self._links(level, min_support, min_length).select(F.col("src").alias("t1")).distinct()
        return cliques.weights_to(_members(made, min_length), visits, columns, each)

    def largest_cliques(self, level: Level, min_support: int, min_length: int, k: int) -> DataFrame:
        """group_id, trajectory_idx: the ``k`` largest of ``clique_groups``, of sets of ``min_length`` items or more.

        Sets that are left out of a set have as many members at least and come first, so a
        set with ``k`` such sets is not among them and need not be grown. Places in the
        order of sets are counted, so neither sets nor their cliques are sorted.
        """
        longest = min_length = max(1, min_length)
        while sum(comb(longest + 1, n) for n in range(min_length, longest + 1)) < k:
            longest += 1
        made = self.frequent(level, min_support, longest).sets.filter(F.col("set_id.length") >= min_length)
        sets = made.select(F.struct(F.size("items").alias("n_items"), "items").alias("place"), "support")
        top = materialize(sets.orderBy(F.desc("support"), "place").limit(k), "largest")
        later = F.broadcast(top.select(F.col("place").alias("later")))
        before = sets.join(later, F.col("place") < F.col("later")).groupBy("later").agg(F.count("*").alias("before"))
        named = top.join(before, F.col("place") == F.col("later"), "left").select(F.coalesce("before", F.lit(0)).alias("itemset_id"), "place.items")
        return cliques.match_cliques(named, self.enumerated(level)).withColumnRenamed("itemset_id", "group_id")

    def overlapping(self, level: Level, min_support: int, min_length: int = 1, kind: str = "closed", overlap: float = 0.0) -> DataFrame:
        """group_id, trajectory_idx: the components of pairs that weigh more than ``overlap``.

        The longest frequent set of a pair is as long as its longest closed one. Longer sets than
        make the two longest paths weigh enough tell nothing more, so they are not grown,
        unless that many items are needed that closed sets are better mined.
        """
        most = self.enumerated(level).groupBy("trajectory_idx").count().agg(F.max("count")).first()[0] or 1
        enough = 1
        while enough < most and (2 * enough) / (2 * most) <= overlap:
            enough += 1
        enough = max(enough, min_length)
        if kind == "maximal" or (kind == "closed" and enough > GROWN):
            lengths = self.itemsets(level, min_support, kind).select("itemset_id", F.size("items").alias("n_items"))
            held = self.cliques(level, min_support, min_length, kind).join(lengths, "itemset_id")
            return grouping.group_overlap(grouping.overlap_stars(held, self.enumerated(level), overlap))

        def stars(held: DataFrame) -> DataFrame:
            return grouping.overlap_stars(held, self.enumerated(level), overlap).select(F.col("t1").alias("src"), F.col("t2").alias("dst"))

        linked = self._spanning(level, min_support, min_length, enough, stars)
        return grouping.tied_groups(linked)

    def groups(self, level: Level, min_support: int, min_length: int = 1, kind: str = "closed", strategy: str = "cc", **settings) -> DataFrame:
        if strategy == "cc":
            return self.linked(level, min_support, min_length, kind)
        if strategy == "overlap":
            return self.overlapping(level, min_support, min_length, kind, settings.get("overlap", 0.0))
        if strategy == "both" and settings.get("edge_mode") == "symmetric" and settings["attach"] > 0 and kind != "maximal":
            return grouping.tied_groups(self._links(level, min_support, min_length))
        found = (self.cliques(level, min_support, min_length, kind),)
        sets, visits = self.itemsets(level, min_support, kind), self.enumerated(level)
        if strategy == "nc":
            return grouping.group_nc(*found, [settings["threshold"]])
        if strategy == "wc":
            return grouping.group_wc(*found, sets, visits, [settings["threshold"]])
        if strategy == "attachment":
            return grouping.group_attachment(*found, sets, [settings["threshold"]], settings.get("index", "position"))
        if strategy == "both":
            return grouping.group_both(*found, sets, visits, **settings)
        raise ValueError(f"no strategy {strategy}")

    def all_levels(self, space_bits: int, shift_t: int, **settings) -> dict[int, DataFrame]:
        """Groups at every spatial level, from the coarsest to the grid itself."""
        return {n: self.groups(Level(space_bits - n, space_bits - n, shift_t), **settings) for n in range(space_bits)}

    def stage_stats(self, level: Level, min_support: int, min_length: int = 1, kind: str = "closed") -> DataFrame:
        """line, label, value: what each stage holds."""
        visits = self.enumerated(level)
        sets, found = self.itemsets(level, min_support, kind), self.cliques(level, min_support, min_length, kind)
        counts = [
            ("trajectories", visits.agg(F.count_distinct("trajectory_idx").alias("value"))),
            ("unique_items", visits.agg(F.count_distinct("item_id").alias("value"))),
            ("itemsets", sets.agg(F.count("*").alias("value"))),
            ("cliques", found.agg(F.count_distinct("itemset_id").alias("value"))),
            ("groups", grouping.group_cc(found).agg(F.count_distinct("group_id").alias("value"))),
        ]
        rows = [df.select(F.lit(i).cast("long").alias("line"), F.lit(label).alias("label"), F.col("value").cast("long").alias("value")) for i, (label, df) in enumerate(counts)]
        stats = rows[0]
        for row in rows[1:]:
            stats = stats.unionAll(row)
        return stats


def _members(made: mining.Frequent, min_length: int, max_length: int | None = None) -> DataFrame:
    length = F.col("set_id.length")
    fitting = (length >= min_length) & (length <= max_length) if max_length else length >= min_length
    held = made.holders.filter(fitting).join(made.owners, "basket")
    return held.select(F.col("set_id").alias("itemset_id"), F.col("set_id.length").alias("n_items"), F.col("key").alias("trajectory_idx"))


def min_support(samples: DataFrame) -> int:
    """A tenth of the trajectories, and four at least."""
    n = samples.select("trajectory_id").distinct().count()
    return max(4, -(-n // 10))


def flagship(samples: DataFrame, overlap: float = 0.09) -> DataFrame:
    """The largest groups of objects whose cells overlap enough."""
    samples = materialize(samples, "samples")
    groups = Discovery(samples).groups(Level(5, 5, 5), min_support(samples), 3, strategy="overlap", overlap=overlap)
    return grouping.topk_groups(groups, 5)
