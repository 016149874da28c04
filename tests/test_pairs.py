"""Cliques by rarest cell and pairs by their bounds, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from driftmesh.operators import cliques
from driftmesh.plans import catalogue
from driftmesh.storage import materialize


@pytest.fixture(scope="module")
def visits(spark):
    """Trajectories of 1 to 60 cells; cell 0 is in almost all, and many itemsets have the same visitors."""
    rng = random.Random(3)
    held = {t: sorted({0} | {rng.randrange(1, 9) for _ in range(rng.choice([1, 3, 8]))} | {1000 + 60 * t + k for k in range(rng.choice([0, 5, 50]))}) for t in range(70)}
    held[70] = [5]
    sets = [[0], [5], [0, 5]] + [sorted(rng.sample(range(9), rng.randint(2, 5))) for _ in range(60)] + [[4, 777]]
    enumerated = materialize(spark.createDataFrame([(t, i) for t, own in held.items() for i in own], "trajectory_idx long, item_id long"), "visits")
    itemsets = materialize(spark.createDataFrame(list(enumerate(sets)), "itemset_id long, items array<long>"), "sets")
    return held, sets, enumerated, itemsets


@pytest.mark.parametrize("salts", [1, 8])
def test_matching(visits, salts):
    held, sets, enumerated, itemsets = visits
    expected = {(k, t) for k, s in enumerate(sets) for t, own in held.items() if set(s) <= set(own)}
    got = [tuple(r) for r in cliques.match_cliques(itemsets, enumerated, salts).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def slow_weights(held, sets, above, last):
    best = {}
    for s in sets:
        own = [t for t in held if set(s) <= set(held[t])]
        for a in own:
            for b in own:
                w = 2 * len(s) / (len(held[a]) + len(held[b]))
                best[a, b] = w if last else max(w, best.get((a, b), 0))
    return {pair: round(w, 9) for pair, w in best.items() if w > above}


@pytest.mark.parametrize("above", [0.0, 0.02, 0.1, 2 * 3 / 13, 0.5, 0.99, 1.5])
def test_heaviest_and_last_weights(visits, above):
    held, sets, enumerated, itemsets = visits
    found = materialize(cliques.match_cliques(itemsets, enumerated), "cliques")

    def weights(df):
        rows = [((r["t1"], r["t2"]), round(r["w"], 9)) for r in df.collect()]
        assert len(rows) == len(dict(rows))
        return dict(rows)

    assert weights(cliques.weight_max(found, itemsets, enumerated, above)) == slow_weights(held, sets, above, False)
    if not above:
        assert weights(cliques.weight_last(found, itemsets, enumerated)) == slow_weights(held, sets, 0, True)
        assert {tuple(r) for r in cliques.connections(found).collect()} == set(slow_weights(held, sets, 0, True))
        least = cliques.weighted(found, F.min("w"), itemsets, enumerated)
        assert len(weights(least)) == len(slow_weights(held, sets, 0, True))


def test_equal_cliques_are_one(visits):
    held, sets, enumerated, itemsets = visits
    found = materialize(cliques.match_cliques(itemsets, enumerated), "cliques")
    kept = cliques.distinct_cliques(found, itemsets.select("itemset_id", F.size("items").alias("rank")))
    by_members = {}
    for k, s in enumerate(sets):
        own = tuple(t for t in held if set(s) <= set(held[t]))
        if own:
            by_members[own] = max(by_members.get(own, (0, 0)), (len(s), k))
    assert {r["itemset_id"] for r in kept.select("itemset_id").distinct().collect()} == {k for _, k in by_members.values()}
    assert len(by_members) < len(sets) - 1


def test_pairs_below_the_bound_are_not_made(spark):
    found = catalogue._Found(spark, "/root/testdata/sf0.01", min_length=2)
    held = found.cliques
    every = cliques._half_with_length(held, found.itemsets).count()
    made = cliques.close_pairs(held, found.itemsets, found.enumerated, 0.045).count()
    assert 0 < made * 4 < every


@pytest.mark.parametrize("part_cliques", [3, 1024])
def test_overlap_of_cliques(visits, part_cliques):
    held, sets, enumerated, itemsets = visits
    found = materialize(cliques.match_cliques(itemsets, enumerated), "cliques")
    own = [{t for t in held if set(s) <= set(held[t])} for s in sets]
    expected = {(a, b, len(own[a] & own[b]), len(own[a] | own[b])) for a in range(len(sets)) for b in range(a + 1, len(sets)) if own[a] & own[b]}
    got = [tuple(r) for r in cliques.clique_overlap(found, part_cliques).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert cliques.clique_overlap(found.limit(0)).count() == 0


def test_alike_members_meet_once(spark):
    """1,000 members of the same 40 cliques make the pairs of one; a member of few makes its own."""
    rows = [(k, t) for k in range(40) for t in range(1000)] + [(0, 5000), (7, 5000)]
    found = spark.createDataFrame(rows, "itemset_id long, trajectory_idx long")
    classes = cliques._member_classes(found)
    assert classes.count() == 42
    assert classes.agg(F.sum("n_alike")).first()[0] == 40_000 + 2
    got = {(r["g1"], r["g2"]): r["n_shared"] for r in cliques.clique_overlap(found, 16).collect()}
    assert len(got) == 780 and got.pop((0, 7)) == 1001 and set(got.values()) == {1000}


@pytest.mark.parametrize("block", [8, 1024])
def test_pairs_by_blocks(spark, visits, block, monkeypatch):
    """Each pair once, whatever the number of its cliques and blocks, with the longest itemset."""
    held, sets, enumerated, _ = visits
    sets = sorted(sets, key=len)
    itemsets = materialize(spark.createDataFrame(list(enumerate(sets)), "itemset_id long, items array<long>"), "sets")
    found = materialize(cliques.match_cliques(itemsets, enumerated), "cliques")
    expected = {p: w for p, w in slow_weights(held, sets, 0, True).items()}
    made = cliques.longest_shared(found, itemsets, enumerated, block).collect()
    got = {(r["t1"], r["t2"]): 2 * r["n_items"] / (r["n1"] + r["n2"]) for r in made}
    assert len(made) == len(got) and got == pytest.approx(expected)
    monkeypatch.setattr(cliques, "REPEATS", 0)
    weights = cliques.weight_last(found, itemsets, enumerated)
    assert "FlatMapGroupsInArrow" in weights._jdf.queryExecution().executedPlan().toString()
    assert {(r["t1"], r["t2"]): r["w"] for r in weights.collect()} == pytest.approx(expected)
