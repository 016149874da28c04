"""Direct closed and maximal mining against all frequent sets, and what it opens."""

import itertools
import random

import pyarrow as pa
import pytest

from driftmesh.operators import patterns

ITEM = pa.list_(pa.struct([("support", pa.int64()), ("item", pa.int64())]))


def all_frequent(baskets, least):
    items = sorted({i for b in baskets for i in b})
    found, level = {}, [((), [set(b) for b in baskets if b])]
    while level:
        grown = []
        for chosen, rows in level:
            for i in items:
                if not chosen or i > chosen[-1]:
                    own = [r for r in rows if i in r]
                    if len(own) >= least:
                        found[(*chosen, i)] = len(own)
                        grown.append(((*chosen, i), own))
        level = grown
    return found


def closed(found):
    return {s: n for s, n in found.items() if not any(n == m and set(s) < set(t) for t, m in found.items() if len(t) == len(s) + 1)}


def maximal(found):
    return {s: n for s, n in found.items() if not any(set(s) < set(t) for t in found if len(t) == len(s) + 1)}


def frame(spark, baskets):
    return spark.createDataFrame([(list(b),) for b in baskets], "items array<bigint>").repartition(3)


def sets_of(df):
    rows = [(tuple(r["items"]), r["support"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def drawn(seed, n=60, items=9):
    rng = random.Random(seed)
    shares = [rng.choice([0.2, 0.5, 0.9]) for _ in range(items)]
    return [[i * 7 % 23 for i in range(items) if rng.random() < shares[i]] for _ in range(n)] + [[], [3], [3]]


@pytest.mark.parametrize("limit", [100_000, 12, 0])
@pytest.mark.parametrize("seed, least", [(1, 2), (2, 6), (3, 20)])
def test_against_all_sets(spark, seed, least, limit):
    baskets = drawn(seed)
    if seed == 2:
        baskets = [[*b, 99, 100] for b in baskets]  # items that all baskets hold
    found = all_frequent(baskets, least)
    df = frame(spark, baskets)
    assert sets_of(patterns.closed_itemsets(df, least, limit=limit)) == closed(found)
    assert sets_of(patterns.maximal_itemsets(df, least, limit=limit)) == maximal(found)


def test_edges(spark):
    for mine in (patterns.closed_itemsets, patterns.maximal_itemsets):
        assert sets_of(mine(frame(spark, [[]]), 1)) == {}
        assert sets_of(mine(frame(spark, [[5, 4]] * 3), 0)) == {(4, 5): 3}
        assert sets_of(mine(frame(spark, [[5, 4]] * 3), 4)) == {}
        assert sets_of(mine(frame(spark, [[1, 1, 2], [1]]), 1)) == ({(1,): 2, (1, 2): 1} if mine is patterns.closed_itemsets else {(1, 2): 1})
        with pytest.raises(ValueError):
            mine(frame(spark, [[1]]), -1)


def miners(baskets, least):
    """The searches of all items, as the tasks run them."""
    support = {}
    for b in baskets:
        for i in b:
            support[i] = support.get(i, 0) + 1
    order = sorted((n, i) for i, n in support.items() if n >= least)
    for entry in order:
        rows = [[e for e in order if e[1] in b and e != entry] for b in baskets if entry[1] in b]
        made = pa.table({
            "have": pa.array([[dict(zip(("support", "item"), entry))]] * len(rows), ITEM),
            "items": pa.array([[dict(zip(("support", "item"), e)) for e in row] for row in rows], ITEM),
            "weight": pa.array([1] * len(rows), pa.int64()),
        })
        yield patterns.miner_of(made, least)[0]


def dense(seed=6):
    """Baskets of one of four long runs of items, some with one left out: very many frequent sets, few closed ones."""
    rng = random.Random(seed)
    runs = [list(range(b * 2, b * 2 + 17)) for b in range(4)]
    return [sorted(set(run) - ({rng.choice(run[::5])} if k % 5 == 0 else set())) for run in runs for k in range(40)]


def test_closed_sets_are_all_that_is_made(spark):
    """On a dense table all frequent sets are a hundred times as many as what the search opens."""
    baskets, least = dense(), 30
    made = opened = 0
    for miner in miners(baskets, least):
        made += sum(1 for _ in miner.closed())
        opened += miner.opened
    singles = {i for b in baskets for i in b}
    full = max(set(map(tuple, baskets)), key=lambda b: baskets.count(list(b)))
    assert baskets.count(list(full)) >= least
    assert made > 10 and (1 << len(full)) - 1 > 100 * opened
    assert opened <= made * len(singles)
    got = sets_of(patterns.closed_itemsets(frame(spark, baskets), least))
    assert len(got) == made
    for items, support in got.items():
        rows = [set(b) for b in baskets if set(items) <= set(b)]
        assert len(rows) == support and set.intersection(*rows) == set(items)


def test_branches_stay_near_maximal_sets(spark):
    baskets, least = dense(), 30
    opened, found = 0, []
    for miner in miners(baskets, least):
        found += list(miner.maximal())
        opened += miner.opened
    singles = {i for b in baskets for i in b}
    assert opened <= len(found) + 3 * len(singles)
    got = sets_of(patterns.maximal_itemsets(frame(spark, baskets), least))
    assert len(got) == len(found)
    for items in got:
        support = lambda s: sum(s <= set(b) for b in baskets)
        assert support(set(items)) >= least and all(support({*items, i}) < least for i in singles - set(items))
    for a, b in itertools.combinations(got, 2):
        assert not set(a) <= set(b) and not set(b) <= set(a)
