"""Order-dependent merging, component by component, against the whole list in one go."""

import random

import pytest
from pyspark.sql import functions as F

from driftmesh.operators import agglomerate, grouping
from driftmesh.operators.cliques import connections, weight_last
from driftmesh.storage import materialize

N = 1000


def slow_directed(nodes, edges):
    """One pass over all groups for each merge; ids are those of the first group."""
    groups = [(n, [n]) for n in sorted(nodes)]
    while True:
        place = {m: k for k, (_, group) in enumerate(groups) for m in group}
        pair = None
        for k, (_, group) in enumerate(groups):
            for member in group:
                later = [place[b] for a, b in edges if a == member and b != a and place.get(b, -1) > k]
                if later:
                    pair = (k, min(later))
                    break
            if pair:
                break
        if pair is None:
            return [g for g in groups if len(g[1]) > 1]
        merged = (groups[pair[0]][0], sorted(groups[pair[0]][1] + groups[pair[1]][1]))
        groups = [g for k, g in enumerate(groups) if k not in pair] + [merged]


@pytest.mark.parametrize("seed", range(60))
def test_directed(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 14)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))}
    attached = [sorted(rng.sample(range(n), rng.randint(1, min(4, n)))) for _ in range(rng.randint(0, 3))]
    every = edges | {(a, b) for m in attached for a in m for b in m if a < b}
    assert agglomerate.DirectedMerger(list(range(n)), edges, attached).run() == slow_directed(range(n), every)


@pytest.fixture(scope="module")
def scattered(spark):
    """A thousand parts that share no member, of two to four cliques each."""
    rng = random.Random(9)
    cliques, lengths = [], {}
    for part in range(N):
        for _ in range(rng.randint(2, 4)):
            name = len(lengths)
            lengths[name] = rng.randint(1, 5)
            cliques += [(name, 10 * part + m) for m in rng.sample(range(6), rng.randint(2, 4))]
    shuffled = list(lengths)
    rng.shuffle(shuffled)  # parts are mixed in list order
    cliques = [(shuffled[name], m) for name, m in cliques]
    held = materialize(spark.createDataFrame(cliques, "itemset_id long, trajectory_idx long"), "cliques")
    sets = spark.createDataFrame([(shuffled[k], list(range(n))) for k, n in lengths.items()], "itemset_id long, items array<long>")
    visits = spark.createDataFrame([(t, i) for t in {m for _, m in cliques} for i in range(5 + t % 7)], "trajectory_idx long, item_id long")
    return held, materialize(sets, "sets"), materialize(visits, "visits")


def listed(held):
    by_id = {}
    for r in held.collect():
        by_id.setdefault(r["itemset_id"], []).append(r["trajectory_idx"])
    return sorted(by_id), [sorted(by_id[k]) for k in sorted(by_id)]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["threshold"], r["group_id"]), []).append(r["trajectory_idx"])
    return {k: sorted(m) for k, m in out.items()}


def test_each_component_is_a_group_of_its_own(scattered):
    held, sets, _ = scattered
    rows = grouping._facts(grouping._components(held), held, connections(held), sets)
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("a").alias("cliques")).collect()
    assert len(sizes) >= N and max(r["n"] for r in sizes) < 60


def test_same_as_the_whole_list(scattered):
    held, sets, visits = scattered
    ids, cliques = listed(held)
    lengths = [float(len(r["items"])) for r in sets.orderBy("itemset_id").collect() if r["itemset_id"] in set(ids)]
    linked = {(r["t1"], r["t2"]): 1.0 for r in connections(held).collect()}
    weights = {(r["t1"], r["t2"]): r["w"] for r in weight_last(held, sets, visits).collect()}

    def named(threshold, groups):
        return {(threshold, ids[first]): members for first, members in groups}

    expected = named(0.3, agglomerate.Linkage(cliques, linked, 0.3).run()) | named(0.8, agglomerate.Linkage(cliques, linked, 0.8).run())
    assert found(grouping.group_nc(held, [0.3, 0.8])) == expected
    assert found(grouping.group_wc(held, sets, visits, [0.1])) == named(0.1, agglomerate.Linkage(cliques, weights, 0.1).run())
    assert found(grouping.group_attachment(held, sets, [0.5], "id")) == named(0.5, agglomerate.Attachment(cliques, lengths, 0.5, "id").run())
    assert found(grouping.group_attachment(held, sets, [0.5])) == named(0.5, agglomerate.Attachment(cliques, lengths, 0.5).run())
