"""Which trajectories hold an itemset, and how strongly that ties them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parts that the visitors of an item are dealt to, so that a hot item is not one key.
SALTS = 8
#: Classes of trajectory sizes in each doubling.
CLASSES = 4
#: Cliques of a member that meet the others in one task.
PART_CLIQUES = 1024
#: Members of a block, of which two meet in one task, and itemsets that they are compared by at once.
BLOCK, STRIP = 1024, 4096
#: Pairs made by cliques for each pair of members from which on members meet by blocks.
REPEATS = 4


def match_cliques(itemsets: DataFrame, enumerated: DataFrame, salts: int = SALTS) -> DataFrame:
    """itemset_id, trajectory_idx: trajectories that visit all cells of an itemset.

    An itemset is looked for only among the visitors of its rarest cell, so what is made
    is no more than the visits of rarest cells. Visitors of a cell are dealt to ``salts`` parts,
    and the itemsets that it is the rarest of go to each.
    """
    support = enumerated.groupBy("item_id").agg(F.count("*").alias("__support"))
    spread = itemsets.select("itemset_id", "items", F.explode("items").alias("item_id")).join(support, "item_id")
    rarest = spread.groupBy("itemset_id").agg(F.min_by("item_id", F.struct("__support", "item_id")).alias("item_id"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__part")
    wanted = itemsets.select("itemset_id", "items").join(rarest, "itemset_id").select("itemset_id", "items", "item_id", parts)
    part = F.pmod(F.xxhash64("trajectory_idx"), F.lit(salts)).cast("int").alias("__part")
    met = wanted.join(enumerated.select("item_id", "trajectory_idx", part), ["item_id", "__part"])
    held = enumerated.groupBy("trajectory_idx").agg(F.collect_list("item_id").alias("__held"))
    # the cells of a trajectory come once to all itemsets that may be its own, not with each of its visits
    found = met.join(held, "trajectory_idx").filter((F.size("items") == 1) | (F.size(F.array_except("items", "__held")) == 0))
    return found.select("itemset_id", "trajectory_idx")


def distinct_cliques(cliques: DataFrame, order: DataFrame) -> DataFrame:
    """Of cliques with the same members the one whose ``order`` (itemset_id, rank) is the greatest.

    Members are told apart by their number and 128 bits of a hash of them all, which
    combines before the shuffle, so that no clique is gathered anywhere.
    """
    bits = [F.bit_xor(h).alias(f"__h{k}") for k, h in enumerate((F.xxhash64("trajectory_idx"), F.xxhash64(F.lit("second half"), "trajectory_idx")))]
    named = cliques.groupBy("itemset_id").agg(F.count("*").alias("__n"), *bits).join(order, "itemset_id")
    chosen = named.groupBy("__n", "__h0", "__h1").agg(F.max_by("itemset_id", F.struct("rank", "itemset_id")).alias("itemset_id"))
    return cliques.join(chosen.select("itemset_id"), "itemset_id", "left_semi")


def _members(cliques: DataFrame, *more: str) -> DataFrame:
    """Members as t1, dealt out evenly: pairs are many more rows than their members,
    so the tasks that make them are not to be merged for their small input."""
    n = int(cliques.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = cliques.select("itemset_id", *more, F.col("trajectory_idx").alias("t1"))
    return members.repartition(n, "itemset_id", "t1")


def co_members(cliques: DataFrame) -> DataFrame:
    """itemset_id, t1, t2: all ordered pairs of a clique, each with itself too."""
    left = _members(cliques)
    return left.join(cliques.select("itemset_id", F.col("trajectory_idx").alias("t2")), "itemset_id")


def _half(cliques: DataFrame) -> DataFrame:
    """The pairs of ``co_members`` with t1 <= t2."""
    right = cliques.select("itemset_id", F.col("trajectory_idx").alias("t2"))
    return _members(cliques).join(right, "itemset_id").filter("t1 <= t2")


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Pairs in both orders."""
    rest = [c for c in pairs.columns if c not in ("t1", "t2")]
    swapped = pairs.filter("t1 < t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), *rest)
    return pairs.select("t1", "t2", *rest).unionAll(swapped)


def connections(cliques: DataFrame) -> DataFrame:
    """t1, t2 of trajectories that share a clique."""
    any_order = cliques.select("itemset_id").distinct().withColumn("rank", F.lit(0))
    return _mirrored(_half(distinct_cliques(cliques, any_order)).select("t1", "t2").distinct())


def share(n_items: Column) -> Column:
    """What a pair with sizes n1 and n2 weighs."""
    return (n_items * 2).cast("double") / (F.col("n1") + F.col("n2")).cast("double")


def path_sizes(enumerated: DataFrame) -> DataFrame:
    return enumerated.groupBy("trajectory_idx").agg(F.count("*").alias("n"))


def _sized(pairs: DataFrame, enumerated: DataFrame) -> DataFrame:
    sizes = path_sizes(enumerated)
    return pairs.join(sizes.toDF("t1", "n1"), "t1").join(sizes.toDF("t2", "n2"), "t2")


def _lengths(itemsets: DataFrame) -> DataFrame:
    return itemsets.select("itemset_id", F.size("items").alias("n_items"))


def _half_with_length(cliques: DataFrame, itemsets: DataFrame) -> DataFrame:
    left = _members(cliques.join(_lengths(itemsets), "itemset_id"), "n_items")
    right = cliques.select("itemset_id", F.col("trajectory_idx").alias("t2"))
    return left.join(right, "itemset_id").filter("t1 <= t2")


def _meet_often(cliques: DataFrame) -> bool:
    """Whether cliques make the same pairs over and over."""
    sizes = cliques.groupBy("itemset_id").agg(F.count("*").alias("n"))
    made = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    return made > REPEATS * float(cliques.select("trajectory_idx").distinct().count()) ** 2


def _last_is_longest(itemsets: DataFrame) -> bool:
    """Whether itemsets are numbered by length, as in canonical order."""
    spans = itemsets.groupBy(F.size("items").alias("n")).agg(F.min("itemset_id").alias("low"), F.max("itemset_id").alias("high")).orderBy("n").collect()
    return all(a["high"] < b["low"] for a, b in zip(spans, spans[1:], strict=False))


def _longest_common(one: list[np.ndarray], other: list[np.ndarray], lengths: dict[int, int]) -> np.ndarray:
    """The length of the longest itemset that each of ``one`` holds together with each of ``other``, else 0."""
    best = np.zeros((len(one), len(other)), np.int32)
    common = np.intersect1d(np.concatenate(one), np.concatenate(other))
    size = np.array([lengths[i] for i in common.tolist()], np.int32)
    for length in np.unique(size)[::-1]:
        own = common[size == length]
        for at in range(0, len(own), STRIP):
            strip = own[at : at + STRIP]
            held = [np.stack([np.isin(strip, sets, assume_unique=True) for sets in side]).astype(np.float32) for side in (one, other)]
            best[(best == 0) & (held[0] @ held[1].T > 0)] = length
        if best.all():
            break
    return best


def longest_shared(cliques: DataFrame, itemsets: DataFrame, enumerated: DataFrame, block: int = BLOCK) -> DataFrame:
    """t1, t2, n_items, n1, n2 in both orders: the longest itemset of each pair of members that share one.

    For cliques that overlap so much that a join would make each pair once for each of
    them. Members are dealt to blocks, and every two blocks meet in a task that multiplies
    their tables of members by itemsets: a pair is made once, and memory is that of two blocks.
    """
    held = cliques.join(_lengths(itemsets), "itemset_id").groupBy("trajectory_idx").agg(F.collect_list(F.struct("itemset_id", "n_items")).alias("s"))
    parts = max(1, -(-cliques.select("trajectory_idx").distinct().count() // block))
    rows = held.join(path_sizes(enumerated), "trajectory_idx").select(
        F.col("trajectory_idx").alias("t"), "n", F.col("s.itemset_id").alias("sets"), F.col("s.n_items").alias("lengths"), F.pmod(F.xxhash64("trajectory_idx"), F.lit(parts)).cast("int").alias("own")
    )
    sent = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("*", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def meet(table: pa.Table) -> pa.Table:
        own, low = table.column("own").to_numpy(), table.column("a")[0].as_py()
        sets = [np.asarray(v.values) for v in table.column("sets")]
        lengths = {i: n for ids, ns in zip(sets, table.column("lengths"), strict=True) for i, n in zip(ids.tolist(), ns.as_py(), strict=True)}
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == table.column("b")[0].as_py())
        made: list[np.ndarray] = [np.zeros((5, 0), np.int64)]
        if len(left) and len(right):
            best = _longest_common([sets[k] for k in left], [sets[k] for k in right], lengths)
            x, y = np.nonzero(best)
            t, n = table.column("t").to_numpy(), table.column("n").to_numpy()
            ta, tb, na, nb = t[left[x]], t[right[y]], n[left[x]], n[right[y]]
            found = best[x, y].astype(np.int64)
            made.append(np.stack([ta, tb, found, na, nb]))
            if low != table.column("b")[0].as_py():  # a block meets itself in both orders already
                made.append(np.stack([tb, ta, found, nb, na]))
        return pa.table(dict(zip(("t1", "t2", "n_items", "n1", "n2"), np.concatenate(made, axis=1), strict=True)))

    return sent.groupBy("a", "b").applyInArrow(meet, "t1 long, t2 long, n_items long, n1 long, n2 long")


def weight_last(cliques: DataFrame, itemsets: DataFrame, enumerated: DataFrame) -> DataFrame:
    """t1, t2, w: the share of common cells by the last clique of the two.

    A pair's weight depends on its cliques through the length of one itemset only,
    so pairs are aggregated, in one order, before they meet the trajectories' sizes.
    In canonical order the last itemset is a longest one.
    """
    if _meet_often(cliques) and _last_is_longest(itemsets):
        return longest_shared(cliques, itemsets, enumerated).select("t1", "t2", share(F.col("n_items")).alias("w"))
    last = distinct_cliques(cliques, cliques.select("itemset_id", F.col("itemset_id").alias("rank")).distinct())
    pairs = _half_with_length(last, itemsets).groupBy("t1", "t2").agg(F.max_by("n_items", "itemset_id").alias("n_items"))
    return _mirrored(_sized(pairs, enumerated).select("t1", "t2", share(F.col("n_items")).alias("w")))


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) * CLASSES).cast("int")


def close_pairs(cliques: DataFrame, itemsets: DataFrame, enumerated: DataFrame, above: float) -> DataFrame:
    """n_items and both sizes of the pairs in a clique that may weigh more than ``above`` (> 0).

    A pair does if its sizes add up to less than twice the clique's length over
    ``above``. So a member stays only if it has room for the clique's smallest one, and
    meets only those of the classes of sizes that are left to it, and no larger than its
    own: classes are a part of the join's key, and pairs beyond them are never made.
    """
    longest = distinct_cliques(cliques, _lengths(itemsets).withColumnRenamed("n_items", "rank"))
    room = (F.col("n_items") * 2 / F.lit(float(above)) + 1).cast("long")  # one more than needed, as w is compared at the end
    members = longest.join(_lengths(itemsets), "itemset_id").join(path_sizes(enumerated), "trajectory_idx").withColumn("room", room)
    smallest = members.groupBy("itemset_id").agg(F.min("n").alias("least"))
    fitting = members.join(smallest, "itemset_id").filter(F.col("n") + F.col("least") <= F.col("room"))
    left_over = F.least(F.col("n"), F.col("room") - F.col("n"))
    larger = fitting.select("itemset_id", "n_items", "room", F.col("trajectory_idx").alias("a"), F.col("n").alias("na"), F.explode(F.sequence(_size_class(F.col("least")), _size_class(left_over))).alias("class"))
    smaller = fitting.select("itemset_id", F.col("trajectory_idx").alias("b"), F.col("n").alias("nb"), _size_class(F.col("n")).alias("class"))
    ordered = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") <= F.col("a")))
    made = larger.join(smaller, ["itemset_id", "class"]).filter(ordered & (F.col("na") + F.col("nb") <= F.col("room")))
    return made.select(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2"), "n_items", F.col("na").alias("n1"), F.col("nb").alias("n2"))


def weight_max(cliques: DataFrame, itemsets: DataFrame, enumerated: DataFrame, above: float = 0.0) -> DataFrame:
    """t1, t2, w: the largest share of common cells, if greater than ``above``."""
    if above > 0:
        pairs = close_pairs(cliques, itemsets, enumerated, above)
        heaviest = pairs.groupBy("t1", "t2").agg(F.max(share(F.col("n_items"))).alias("w"))
        return _mirrored(heaviest.filter(F.col("w") > above))
    longest = distinct_cliques(cliques, _lengths(itemsets).withColumnRenamed("n_items", "rank"))
    pairs = _half_with_length(longest, itemsets).groupBy("t1", "t2").agg(F.max("n_items").alias("n_items"))
    return _mirrored(_sized(pairs, enumerated).select("t1", "t2", share(F.col("n_items")).alias("w")).filter(F.col("w") > above))


def weights_to(members: DataFrame, enumerated: DataFrame, columns: list[int], each: DataFrame | None = None) -> DataFrame:
    """t1, t2, w as by ``weight_max``, with ``columns`` as t2 only; and each member once without t2 and w.

    ``members``: itemset_id, n_items, trajectory_idx. Only pairs with one of ``columns`` are made.
    ``each``: all members as t1, if ``members`` are only those of sets that ``columns`` hold.
    """
    right = members.filter(F.col("trajectory_idx").isin(columns)).select("itemset_id", F.col("trajectory_idx").alias("t2"))
    met = members.withColumnRenamed("trajectory_idx", "t1").join(right, "itemset_id").groupBy("t1", "t2").agg(F.max("n_items").alias("n_items"))
    made = _sized(met, enumerated).select("t1", "t2", share(F.col("n_items")).alias("w"))
    each = members.select(F.col("trajectory_idx").alias("t1")).distinct() if each is None else each
    return made.unionAll(each.select("t1", F.lit(None).cast("long"), F.lit(None).cast("double")))


def weighted(cliques: DataFrame, weight: Column, itemsets: DataFrame, enumerated: DataFrame) -> DataFrame:
    """t1, t2, w by any aggregate over the pairs' columns itemset_id and w, which are the same in both orders."""
    pairs = _sized(_half_with_length(cliques, itemsets), enumerated)
    return _mirrored(pairs.withColumn("w", share(F.col("n_items"))).groupBy("t1", "t2").agg(weight.alias("w")))


def edge_matrix(edges: DataFrame, columns: list[int]) -> DataFrame:
    """Edges as a matrix, a column for each of ``columns``."""
    return edges.groupBy("t1").pivot("t2", columns).agg(F.first("w"))


def _member_classes(cliques: DataFrame) -> DataFrame:
    """itemset_id, m, n_alike, n_cliques: one member for all that are in the same cliques.

    Classes are told apart by the number of their cliques and 128 bits of a hash of them
    all, which combines before the shuffle.
    """
    bits = [F.bit_xor(h).alias(f"__h{k}") for k, h in enumerate((F.xxhash64("itemset_id"), F.xxhash64(F.lit("second half"), "itemset_id")))]
    seen = cliques.groupBy("trajectory_idx").agg(F.count("*").alias("n_cliques"), *bits)
    classes = seen.groupBy("n_cliques", "__h0", "__h1").agg(F.min("trajectory_idx").alias("trajectory_idx"), F.count("*").alias("n_alike"))
    return cliques.join(classes, "trajectory_idx").select("itemset_id", F.col("trajectory_idx").alias("m"), "n_alike", "n_cliques")


def clique_overlap(cliques: DataFrame, part_cliques: int = PART_CLIQUES) -> DataFrame:
    """g1 < g2, n_shared, n_union of cliques with a common member; rows of ``cliques`` are distinct.

    Members that are in the same cliques meet once, as one of their number. The cliques
    of a hot member are dealt to parts of about ``part_cliques``, and each part meets all
    of them, so that no task makes all the pairs under a member.
    """
    members = _member_classes(cliques).filter("n_cliques > 1")
    parts = F.ceil(F.col("n_cliques") / F.lit(part_cliques)).cast("int")
    left = members.select(F.col("itemset_id").alias("g1"), "m", "n_alike", F.pmod(F.xxhash64("itemset_id"), parts).cast("int").alias("part"))
    right = members.select(F.col("itemset_id").alias("g2"), "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    shared = left.join(right, ["m", "part"]).filter("g1 < g2").groupBy("g1", "g2").agg(F.sum("n_alike").alias("n_shared"))
    sizes = cliques.groupBy("itemset_id").agg(F.count("*").alias("n"))
    sized = shared.join(sizes.toDF("g1", "n1"), "g1").join(sizes.toDF("g2", "n2"), "g2")
    return sized.select("g1", "g2", "n_shared", (F.col("n1") + F.col("n2") - F.col("n_shared")).alias("n_union"))
