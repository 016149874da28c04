"""Six small baskets with all answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from driftmesh.operators import cliques, grouping, mining
from driftmesh.storage import materialize

BASKETS = [[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 6], [6, 7, 8], [6, 7, 8, 9], [10]]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(t, i) for t, items in enumerate(BASKETS) for i in items]
    enumerated = materialize(spark.createDataFrame(rows, "trajectory_idx long, item_id long"), "golden")
    baskets = enumerated.groupBy("trajectory_idx").agg(F.collect_set("item_id").alias("items"))
    found = mining.frequent_itemsets(baskets, 2)
    sets = materialize(mining.numbered(mining.closed_itemsets(found)), "golden-sets")
    return enumerated, found, sets, materialize(cliques.match_cliques(sets, enumerated), "golden-cliques")


def members(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["group_id"], set()).add(row["trajectory_idx"])
    return sorted(sorted(m) for m in out.values())


def sets_of(df):
    return {tuple(r["items"]): r["support"] for r in df.collect()}


def test_itemsets(golden):
    _, found, sets, _ = golden
    assert sets_of(found) == {
        (1,): 3, (2,): 3, (3,): 2, (6,): 3, (7,): 2, (8,): 2, (1, 2): 3, (1, 3): 2, (2, 3): 2, (6, 7): 2, (6, 8): 2, (7, 8): 2, (1, 2, 3): 2, (6, 7, 8): 2,
    }
    assert {r["n_items"]: r["n_itemsets"] for r in mining.length_histogram(found).collect()} == {1: 6, 2: 6, 3: 2}
    assert {r["itemset_id"]: tuple(r["items"]) for r in sets.collect()} == {0: (6,), 1: (1, 2), 2: (1, 2, 3), 3: (6, 7, 8)}
    assert sets_of(mining.maximal_itemsets(found)) == {(1, 2, 3): 2, (6, 7, 8): 2}


def test_cliques_and_weights(golden):
    enumerated, _, sets, held = golden
    by_set = {}
    for r in held.collect():
        by_set.setdefault(r["itemset_id"], set()).add(r["trajectory_idx"])
    assert by_set == {0: {2, 3, 4}, 1: {0, 1, 2}, 2: {0, 1}, 3: {3, 4}}
    expected = {(0, 1): 0.75, (0, 2): 0.571429, (1, 2): 0.571429, (2, 3): 0.333333, (2, 4): 0.285714, (3, 4): 0.857143}
    for edges in (cliques.weight_max(held, sets, enumerated), cliques.weight_last(held, sets, enumerated)):
        got = {(r["t1"], r["t2"]): round(r["w"], 6) for r in edges.collect() if r["t1"] < r["t2"]}
        assert got == expected


ALL = [[0, 1, 2, 3, 4]]
APART = [[0, 1], [0, 1, 2], [2, 3, 4], [3, 4]]


def test_connected(golden):
    assert members(grouping.group_cc(golden[3])) == ALL


@pytest.mark.parametrize("threshold, expected", [(0.0, ALL), (0.5, [[0, 1, 2], [2, 3, 4]]), (0.8, [[0, 1, 2], [2, 3, 4]]), (1.0, [[0, 1, 2], [2, 3, 4]])])
def test_connections(golden, threshold, expected):
    assert members(grouping.group_nc(golden[3], [threshold])) == expected


@pytest.mark.parametrize("threshold, expected", [(0.0, ALL), (0.3, [[0, 1, 2], [2, 3, 4]]), (0.5, [[0, 1, 2], [2, 3, 4], [3, 4]]), (0.7, APART)])
def test_weights(golden, threshold, expected):
    enumerated, _, sets, held = golden
    assert members(grouping.group_wc(held, sets, enumerated, [threshold])) == expected


@pytest.mark.parametrize("index", ["position", "id"])
@pytest.mark.parametrize("threshold, expected", [(0.3, ALL), (0.5, [[0, 1, 2], [2, 3, 4]]), (0.7, APART), (1.0, APART)])
def test_attachment(golden, threshold, expected, index):
    assert members(grouping.group_attachment(golden[3], golden[2], [threshold], index)) == expected


@pytest.mark.parametrize("above, expected", [(0.0, ALL), (0.3, ALL), (0.5, [[0, 1, 2], [3, 4]]), (0.7, [[0, 1], [3, 4]]), (0.9, [])])
def test_overlap(golden, above, expected):
    enumerated, _, sets, held = golden
    assert members(grouping.group_overlap(cliques.weight_max(held, sets, enumerated, above))) == expected


@pytest.mark.parametrize("overlap, attach", [(0.7, 0.5), (0.9, 0.5), (0.9, 1.0)])
def test_both_symmetric(golden, overlap, attach):
    enumerated, _, sets, held = golden
    assert members(grouping.group_both(held, sets, enumerated, overlap, attach, "symmetric")) == ALL


@pytest.mark.parametrize("overlap, attach, expected", [(0.0, 1.0, ALL), (0.5, 0.5, ALL), (0.7, 0.5, ALL), (0.9, 0.5, [[0, 1, 2, 3]]), (0.9, 1.0, [[0, 1, 2, 3]])])
def test_both_directed(golden, overlap, attach, expected):
    enumerated, _, sets, held = golden
    assert members(grouping.group_both(held, sets, enumerated, overlap, attach)) == expected


def test_topk(spark):
    rows = [(0, m) for m in range(4)] + [(1, 8), (1, 9), (2, 10), (2, 11)]
    groups = spark.createDataFrame(rows, "group_id long, trajectory_idx long")
    assert [tuple(r) for r in grouping.topk_groups(groups, 0).collect()] == [(0, 4), (1, 2), (2, 2)]
    assert [tuple(r) for r in grouping.topk_groups(groups, 2).collect()] == [(0, 4), (1, 2)]


def test_supports_are_clique_sizes(golden):
    _, _, sets, held = golden
    sizes = {r["itemset_id"]: r["count"] for r in held.groupBy("itemset_id").count().collect()}
    assert sizes == {r["itemset_id"]: r["support"] for r in sets.collect()}


def test_mining_edges(spark):
    empty = spark.createDataFrame([], "items array<long>")
    assert mining.frequent_itemsets(empty, 2).count() == 0
    with pytest.raises(ValueError):
        mining.frequent_itemsets(empty, -1)
