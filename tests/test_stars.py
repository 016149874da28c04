"""Groups, matrices and images from stars, chosen columns and the largest sets, against all pairs, all cliques and all strokes."""

import random

import pytest
from pyspark.sql import functions as F

from driftmesh.model import Level
from driftmesh.operators import agglomerate, cliques, grouping, mining, raster
from driftmesh.plans.discovery import Discovery
from driftmesh.storage import materialize


def split(df):
    """The groups of a table as sets of members."""
    found = {}
    for g, t in df.select("group_id", "trajectory_idx").collect():
        found.setdefault(g, set()).add(t)
    assert all(g == min(own) for g, own in found.items())
    return sorted(map(sorted, found.values()))


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(7)
    rows = [(t, t, s, rng.randrange(24), rng.randrange(24), rng.randrange(8), s) for t in range(40) for s in range(rng.choice([1, 4, 12]))]
    return materialize(spark.createDataFrame(rows, "trajectory_idx long, trajectory_id long, seq long, x long, y long, t long, ord long"), "samples")


@pytest.fixture(scope="module")
def found(samples):
    search, level = Discovery(samples), Level(3, 3, 2)
    return search, level, search.cliques(level, 2, 1, "all"), search.itemsets(level, 2, "all"), search.enumerated(level)


def _members(made, sets):
    return made.join(sets.select("itemset_id", F.size("items").alias("n_items")), "itemset_id")


@pytest.mark.parametrize("above", [0.0, 0.2, 2 * 2 / 12, 0.5, 1.5])
def test_stars_have_the_components_of_all_pairs(found, above):
    _, _, made, sets, visits = found
    stars = materialize(grouping.overlap_stars(_members(made, sets), visits, above), "stars")
    pairs = cliques.weight_max(made, sets, visits, above)
    assert {tuple(r) for r in stars.select("t1", "t2").collect()} <= {(r["t1"], r["t2"]) for r in pairs.collect()}
    assert split(grouping.group_overlap(stars)) == split(grouping.group_overlap(pairs))


def test_a_clique_of_many_makes_no_pairs(spark):
    members = spark.range(20_000).select(F.lit(1).cast("long").alias("itemset_id"), F.lit(2).alias("n_items"), F.col("id").alias("trajectory_idx"))
    visits = spark.range(20_000).select(F.col("id").alias("trajectory_idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("item_id"))
    assert grouping.overlap_stars(members, visits, 0.5).count() == 19_999


@pytest.mark.parametrize("kind, overlap, length", [("closed", 0.3, 1), ("all", 0.4, 2), ("maximal", 0.4, 1)])
def test_groups_by_overlap(found, kind, overlap, length):
    search, level, *_ = found
    made, sets, visits = search.cliques(level, 2, length, kind), search.itemsets(level, 2, kind), search.enumerated(level)
    expected = split(grouping.group_overlap(cliques.weight_max(made, sets, visits, overlap)))
    assert split(search.groups(level, 2, length, kind, "overlap", overlap=overlap)) == expected


def test_symmetric_groups_need_no_merges(found):
    search, level, made, sets, visits = found
    own = {}
    for i, t in made.collect():
        own.setdefault(i, []).append(t)
    lengths = {r["itemset_id"]: float(r["n_items"]) for r in sets.collect()}
    attached = agglomerate.merge_by_attachment([own[i] for i in sorted(own)], [lengths[i] for i in sorted(own)], 0.5)
    pairs = [(r["t1"], r["t2"]) for r in cliques.weight_max(made, sets, visits, 0.3).collect()] + [(m[0], t) for m in attached for t in m]
    root = {t: t for p in pairs for t in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    expected = {}
    for t, r in root.items():
        expected.setdefault(r, []).append(t)
    expected = sorted(sorted(g) for g in expected.values() if len(g) > 1)
    assert split(grouping.group_both(made, sets, visits, 0.3, 0.5, "symmetric")) == expected
    assert split(search.groups(level, 2, 1, "all", "both", overlap=0.3, attach=0.5, edge_mode="symmetric")) == expected


def test_weights_to_some(found):
    search, level, made, sets, visits = found
    columns = [0, 3, 99]
    got = {(r["t1"], r["t2"]): r["w"] for r in cliques.weights_to(search.members(level, 2), visits, columns).collect()}
    every = {(r["t1"], r["t2"]): r["w"] for r in cliques.weight_max(made, sets, visits).collect()}
    assert got == {p: w for p, w in every.items() if p[1] in columns} | {(a, None): None for a, _ in every}


@pytest.mark.parametrize("length, k", [(1, 3), (2, 4), (2, 15)])
def test_largest_cliques(found, length, k):
    search, level, *_ = found
    groups = grouping.clique_groups(search.cliques(level, 2, length, "all"))
    top = raster.top_of_each(groups.withColumn("set_id", F.lit(0)), k)
    expected = groups.join(top.select("group_id"), "group_id").select("group_id", "trajectory_idx")
    assert sorted(map(tuple, search.largest_cliques(level, 2, length, k).collect())) == sorted(map(tuple, expected.collect()))


def test_lines_are_painted_as_strokes(spark, samples):
    groups = spark.createDataFrame([(s, t % 5, t) for s in (0, 1) for t in range(40)], "set_id long, group_id long, trajectory_idx long")
    layers = raster.layers(groups, raster.top_of_each(groups, 3))
    lines, strokes = (f(samples, F.lit(24), 30, 30) for f in (raster.lines, raster.strokes))
    for whole in (True, False):
        assert {tuple(r) for r in raster.paint(lines, layers, whole).collect()} == {tuple(r) for r in raster.paint(strokes, layers, whole).collect()}
    assert sorted(map(tuple, raster.ground(lines).collect())) == sorted(map(tuple, raster.ground(strokes).collect()))


def test_offers_are_made_by_many_tasks(spark):
    """A table of a few rows is one task to read, but each basket makes thousands of offers."""
    baskets = spark.range(40).coalesce(1).select(F.col("id").alias("key"), F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long")).alias("items"), F.col("id").alias("own"))
    baskets = baskets.withColumn("items", F.array_append("items", F.floor(F.col("own") / 2) + 100))
    status, group = spark.sparkContext.statusTracker(), "offers"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = mining.frequent_sets(baskets, 2, key="key", max_length=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.sets.count() == 41 + 41 * 40 // 2 - 20 * 19 // 2
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    assert sum(s is not None and s.numCompletedTasks >= 4 for s in stages) >= 2


def test_known_longer_sets_serve_shorter_ones(samples):
    search, level = Discovery(samples), Level(3, 3, 2)
    alone = split(search.linked(level, 2, 2, "all"))
    other = Discovery(samples)
    other.largest_cliques(level, 2, 2, 15)
    assert split(other.linked(level, 2, 2, "all")) == alone
    assert len(other._frequent) == 1
