"""Frequent, closed and maximal itemsets."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.ranking import rank_keys
from driftmesh.storage import materialize


def item_support(enumerated: DataFrame, min_support: int = 1) -> DataFrame:
    """item_id, support of the items in at least ``min_support`` baskets."""
    counted = enumerated.groupBy("item_id").agg(F.count("*").alias("support"))
    return counted.filter(F.col("support") >= max(1, min_support))


def by_support(support: DataFrame) -> DataFrame:
    """``support`` with rank: items numbered from 0, the rarest first, then by id."""
    return support.join(rank_keys(support, ["support", "item_id"], "rank"), ["support", "item_id"])


class Frequent(NamedTuple):
    """Frequent sets, and where they are held; written tables.

    ``sets``: set_id, items (sorted), support. ``holders``: basket, set_id, with baskets
    of the same frequent items as one. ``owners``: basket and the key of each basket of the input.
    """

    sets: DataFrame
    holders: DataFrame
    owners: DataFrame


def frequent_sets(baskets: DataFrame, min_support: int, items: str = "items", key: str | None = None, max_length: int | None = None, held_by: DataFrame | None = None) -> Frequent:
    """All sets of items in enough baskets, of ``max_length`` items at most if given, with the baskets that hold them.

    With ``held_by`` (key) only those sets, of two items or more, that one of these baskets holds,
    with all baskets that do: what these baskets offer is looked up before others' offers are shuffled.

    Sets grow by one later item in each round. A basket offers the sets that it holds with
    each of the items that made their siblings in it; offers are counted, combined before
    the shuffle, and only the frequent ones are kept with their basket. So what is made
    is the pairs of items in each basket, and then no more than siblings held together. Baskets with the same frequent
    items count as one with a weight. Empty baskets are not transactions, and an item
    counts once in a basket.
    """
    if min_support < 0:
        raise ValueError("min_support must not be negative")
    least = max(1, min_support)
    name = F.monotonically_increasing_id() if key is None else F.col(key)
    filled = materialize(baskets.filter(F.size(items) > 0).select(name.alias("key"), F.array_distinct(items).alias("items")), "transactions")
    visits = filled.select("key", F.explode("items").alias("item"))
    single = materialize(visits.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least), "support")
    left = materialize(visits.join(single.select("item"), "item").groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")), "frequent-baskets")
    weighted = materialize(left.groupBy("items").agg(F.count("*").alias("weight")).withColumn("basket", F.monotonically_increasing_id()), "weighted-baskets")
    owners = left.join(weighted.select("items", "basket"), "items").select("basket", "key")
    sets = [single.select(F.col("item").cast("long").alias("set_id"), F.array("item").alias("items"), "support")]
    holders = [weighted.select("basket", F.explode("items").alias("item")).select("basket", F.col("item").cast("long").alias("set_id"))]
    # offers are many more rows than their lists, so the tasks that make them are not to be few for a small input
    n_tasks = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, length = F.transform("items", lambda i: F.struct(i.alias("item"), i.cast("long").alias("set_id"))), 1
    lists = weighted.select("basket", "weight", own.alias("siblings"))

    def offered(lists: DataFrame) -> DataFrame:
        begun = lists.repartition(n_tasks, "basket", "siblings").select("basket", "weight", "siblings", F.posexplode("siblings").alias("at", "first"))
        later = F.expr("slice(siblings, at + 2, size(siblings))")
        return begun.select("basket", "weight", F.col("first.set_id").alias("parent"), F.explode(later).alias("last")).select("basket", "weight", "parent", F.col("last.item").alias("item"))

    chosen = None if held_by is None else materialize(owners.join(held_by.select("key"), "key", "left_semi").select("basket").distinct(), "chosen-baskets")
    while (max_length is None or length < max_length) and not lists.isEmpty():
        length += 1
        offers = offered(lists)
        if chosen is not None:
            asked = materialize(offered(lists.join(chosen, "basket", "left_semi")).select("parent", "item").distinct(), "asked-sets")
            offers = offers.join(asked, ["parent", "item"], "left_semi")
        counted = offers.groupBy("parent", "item").agg(F.sum("weight").alias("support")).filter(F.col("support") >= least)
        found = materialize(counted.withColumn("set_id", F.monotonically_increasing_id()), "sets")
        if found.isEmpty():
            break
        kept = materialize(offers.join(found.select("parent", "item", "set_id"), ["parent", "item"]), "holders")
        parents = sets[-1].select(F.col("set_id").alias("parent"), F.col("items").alias("shorter"))
        named = found.join(parents, "parent").select("set_id", F.concat("shorter", F.array("item")).alias("items"), "support")
        sets.append(materialize(named, "itemsets"))
        holders.append(kept.select("basket", "set_id"))
        if length == max_length:
            break  # no longer sets are asked for
        siblings = F.array_sort(F.collect_list(F.struct("item", "set_id"))).alias("siblings")
        lists = materialize(kept.groupBy("basket", "weight", "parent").agg(siblings).filter(F.size("siblings") > 1), "siblings")
    # numbers of sets are told apart by their length
    marked = [[df.withColumn("set_id", F.struct(F.lit(k).alias("length"), "set_id")) for k, df in enumerate(part, 1)] for part in (sets, holders)]
    return Frequent(*(reduce(DataFrame.unionAll, part) for part in marked), owners)


def frequent_itemsets(baskets: DataFrame, min_support: int, items: str = "items") -> DataFrame:
    """items (sorted), support of all sets of items in enough baskets.

    ``min_support`` is a count; 0 counts as 1 and negative numbers raise. Empty
    baskets are not transactions.
    """
    return frequent_sets(baskets, min_support, items).sets.select("items", "support")


def frequent_cliques(frequent: Frequent, itemsets: DataFrame) -> DataFrame:
    """itemset_id, trajectory_idx: the keys of the baskets that hold each of ``itemsets``, which are some of the frequent ones."""
    named = frequent.sets.select("set_id", "items").join(itemsets.select("itemset_id", "items"), "items").select("set_id", "itemset_id")
    return frequent.holders.join(named, "set_id").join(frequent.owners, "basket").select("itemset_id", F.col("key").alias("trajectory_idx"))


def _without_one(itemsets: DataFrame, *more: str) -> DataFrame:
    """Every itemset of two or more with each of its items left out in turn."""
    at = F.sequence(F.lit(0), F.size("items") - 1)
    subsets = F.transform(at, lambda i: F.filter("items", lambda _, j: j != i))
    return itemsets.filter(F.size("items") > 1).select(F.explode(subsets).alias("items"), *more)


def closed_itemsets(itemsets: DataFrame) -> DataFrame:
    """Itemsets that no larger one has the same support as.

    If a larger one does, one with a single further item does, so one anti-join
    against the sets less an item is enough.
    """
    covered = _without_one(itemsets, "support").distinct()
    return itemsets.join(covered, ["items", "support"], "left_anti")


def maximal_itemsets(itemsets: DataFrame) -> DataFrame:
    """Itemsets that are in no larger frequent one."""
    return itemsets.join(_without_one(itemsets).distinct(), "items", "left_anti")


def numbered(itemsets: DataFrame) -> DataFrame:
    """itemset_id, items, n_items, support in canonical order: by size, then items."""
    sized = itemsets.withColumn("n_items", F.size("items").cast("long"))
    ids = rank_keys(sized, ["n_items", "items"], "itemset_id")
    return sized.join(ids, ["n_items", "items"]).select("itemset_id", "items", "n_items", "support")


def at_least(itemsets: DataFrame, length: int) -> DataFrame:
    """Itemsets of ``length`` items or more; their ids stay."""
    return itemsets.filter(F.size("items") >= length)


def length_histogram(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy(F.size("items").cast("long").alias("n_items")).agg(F.count("*").alias("n_itemsets"))
