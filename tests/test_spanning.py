"""Connections and weights to chosen columns, made from few of the frequent sets, against all of them."""

import random

import pytest
from pyspark.sql import functions as F

from driftmesh.model import Level
from driftmesh.operators import cells, cliques, grouping, mining
from driftmesh.plans.discovery import Discovery
from driftmesh.storage import materialize

LEVEL = Level(0, 0, 0)
SCHEMA = "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long, ord long"


def _samples(spark, paths):
    rows = [(k, k, s, x, 0, 0, s) for k, path in enumerate(paths) for s, x in enumerate(path)]
    return materialize(spark.createDataFrame(rows, SCHEMA), "samples")


@pytest.fixture(scope="module")
def tables(spark):
    """One large group and stray pairs; two halves that never meet; paths of no common cell."""
    rng = random.Random(11)
    crowd = [rng.sample(range(30), 6) for _ in range(40)]
    strays = [[*rng.sample(range(100 + 9 * k, 106 + 9 * k), 4), k] for k in range(8) for _ in range(2)]
    halves = [rng.sample(range(200 * (k % 2), 200 * (k % 2) + 30), 5) for k in range(30)]
    return {name: _samples(spark, paths) for name, paths in {"crowd": crowd + strays + [[7]], "halves": halves, "apart": [[k, 1000 + k] for k in range(5)]}.items()}


def _groups(df):
    return sorted(map(tuple, df.select("group_id", "trajectory_idx").collect()))


@pytest.mark.parametrize("name, support, length", [("crowd", 2, 2), ("halves", 2, 2), ("apart", 1, 2)])
def test_links_have_the_groups_of_all_cliques(tables, name, support, length):
    search = Discovery(tables[name])
    got = _groups(search.linked(LEVEL, support, length, "all"))
    assert got == _groups(grouping.group_cc(search.cliques(LEVEL, support, length, "all")))
    assert len(got) > 0


@pytest.mark.parametrize("name, overlap", [("crowd", 0.5)])
def test_overlap_has_the_groups_of_all_pairs(tables, name, overlap):
    search = Discovery(tables[name])
    got = _groups(search.overlapping(LEVEL, 2, 2, "all", overlap))
    pairs = cliques.weight_max(search.cliques(LEVEL, 2, 2, "all"), search.itemsets(LEVEL, 2, "all"), search.enumerated(LEVEL), overlap)
    assert got == _groups(grouping.group_overlap(pairs))


@pytest.mark.parametrize("name, columns", [("crowd", [0, 3, 41, 56, 99])])
def test_weights_to_columns(tables, name, columns):
    search = Discovery(tables[name])
    got = sorted(map(str, search.weights_to(LEVEL, 2, 2, columns).collect()))
    expected = cliques.weights_to(search.members(LEVEL, 2, 2), search.enumerated(LEVEL), columns)
    assert got == sorted(map(str, expected.collect()))


def test_sets_held_by_some(tables):
    baskets = cells.baskets(Discovery(tables["crowd"]).enumerated(LEVEL))
    every = mining.frequent_sets(baskets, 2, key="trajectory_idx")
    some = baskets.filter("trajectory_idx in (3, 44)").select(F.col("trajectory_idx").alias("key"))
    made = mining.frequent_sets(baskets, 2, key="trajectory_idx", held_by=some)

    def listed(frequent):
        held = frequent.holders.join(frequent.owners, "basket").join(frequent.sets, "set_id")
        found = {}
        for r in held.filter(F.size("items") > 1).collect():
            found.setdefault((tuple(r["items"]), r["support"]), set()).add(r["key"])
        return found

    assert listed(made) == {s: own for s, own in listed(every).items() if own & {3, 44}}


def _held(monkeypatch, run):
    """Rows of holders that were written."""
    rows = [0]

    def counted(df, name):
        made = materialize(df, name)
        rows[0] += made.count() if name == "holders" else 0
        return made

    monkeypatch.setattr(mining, "materialize", counted)
    run()
    return rows[0]


def test_a_large_group_makes_few_sets(spark, monkeypatch):
    rng = random.Random(5)
    samples = _samples(spark, [rng.sample(range(60), 24) for _ in range(40)])
    all_sets = _held(monkeypatch, lambda: mining.frequent_sets(cells.baskets(Discovery(samples).enumerated(LEVEL)), 2, key="trajectory_idx", max_length=2))
    assert _held(monkeypatch, lambda: Discovery(samples).linked(LEVEL, 2, 2, "all")) < all_sets / 2
