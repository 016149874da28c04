"""All frequent sets with the baskets that hold them, and groups that need no long sets."""

import random
from itertools import combinations

import pytest

from driftmesh.model import Level
from driftmesh.operators import mining
from driftmesh.plans import sweep
from driftmesh.plans.discovery import Discovery


@pytest.mark.parametrize("max_length", [None, 2])
def test_sets_and_holders_by_brute_force(spark, max_length):
    dice = random.Random(5)
    baskets = {k: sorted(dice.sample(range(9), dice.randint(0, 6))) for k in range(40)}
    baskets |= {40 + k: baskets[k] for k in range(10)}
    rows = spark.createDataFrame([(k, b + b[:1]) for k, b in baskets.items()], "trajectory_idx long, items array<long>")  # an item twice counts once
    held = {}
    for k, basket in baskets.items():
        for n in range(1, (max_length or 6) + 1):
            for items in combinations(basket, n):
                held.setdefault(items, set()).add(k)
    expected = {(items, k) for items, keys in held.items() if len(keys) >= 4 for k in keys}
    found = mining.frequent_sets(rows, 4, key="trajectory_idx", max_length=max_length)
    sets = [(tuple(r["items"]), r["support"]) for r in found.sets.collect()]
    assert sorted(sets) == sorted((items, len(keys)) for items, keys in held.items() if len(keys) >= 4)
    made = mining.frequent_cliques(found, mining.numbered(found.sets.select("items", "support")).select("itemset_id", "items"))
    names = {r["itemset_id"]: tuple(r["items"]) for r in mining.numbered(found.sets.select("items", "support")).collect()}
    rows = [(names[r["itemset_id"]], r["trajectory_idx"]) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


@pytest.mark.parametrize("kind", ["all", "closed"])
def test_groups_of_long_common_paths_need_no_long_sets(spark, kind):
    """Two that share 30 cells have a thousand million sets in common; one of two cells links them."""
    paths = [(k, s, s, s) for k in (0, 1) for s in range(30)] + [(2, 0, 0, 0), (2, 77, 77, 77)] + [(k, s, 99, s) for k in (3, 4) for s in range(2)]
    rows = spark.createDataFrame([(k, k, s, x, y, s) for s, (k, x, y, _) in enumerate(paths)], "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long").drop("t").selectExpr("*", "x as t")
    search = Discovery(rows)
    status, found, _ = sweep.limited(lambda: search.groups(Level(0, 0, 0), 2, 2, kind).collect(), 100.0)
    assert status == "completed"
    assert sorted((r["group_id"], r["trajectory_idx"]) for r in found) == [(0, 0), (0, 1), (3, 3), (3, 4)]


def test_the_last_round_lists_no_siblings(spark, monkeypatch):
    names, write = [], mining.materialize
    monkeypatch.setattr(mining, "materialize", lambda df, name: names.append(name) or write(df, name))
    rows = spark.createDataFrame([(k, [1, 2, 3]) for k in range(3)], "trajectory_idx long, items array<long>")
    assert mining.frequent_sets(rows, 2, key="trajectory_idx", max_length=2).sets.count() == 6
    assert "holders" in names and "siblings" not in names
