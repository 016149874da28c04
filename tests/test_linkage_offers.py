"""Linked groups offer one pair each, and merge as when all pairs are compared before each merge."""

import random
from math import fsum

import pytest

from driftmesh.operators.agglomerate import Linkage


def slow_linkage(members, weights, threshold):
    groups = [(k, sorted(m)) for k, m in enumerate(members)]
    while True:
        best = None
        for i, (_, a) in enumerate(groups):
            for j in range(i + 1, len(groups)):
                b = groups[j][1]
                shares = [[fsum(weights.get((x, y), 0.0) for y in q) for x in p] for p, q in ((a, b), (b, a))]
                if min(shares[0]) / len(b) >= threshold and min(shares[1]) / len(a) >= threshold:
                    strength = fsum(shares[0] + shares[1])
                    if strength > 0 and (best is None or strength > best[0]):
                        best = (strength, i, j)
        if best is None:
            return groups
        _, i, j = best
        merged = (groups[i][0], sorted({*groups[i][1], *groups[j][1]}))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]


@pytest.mark.parametrize("seed", range(30))
def test_merges_as_all_pairs_do(seed):
    rng = random.Random(seed)
    nodes = rng.randint(3, 10)
    members = [sorted(rng.sample(range(nodes), rng.randint(1, 3))) for _ in range(rng.randint(2, 12))]
    weights = {}
    for a, b in {(min(a, b), max(a, b)) for m in members for a in m for b in m}:
        weights[a, b] = weights[b, a] = rng.choice([0.125, 0.25, 0.5, 1.0])  # sums are exact
    for threshold in (0.0, 0.125, 0.3, 0.8):
        assert Linkage(members, weights, threshold).run() == slow_linkage(members, weights, threshold)


def test_groups_about_a_hub_hold_one_offer_each():
    members = [[0, k] for k in range(1, 301)]
    weights = {pair: 1.0 for _, k in members for pair in ((0, k), (k, 0), (k, k), (0, 0))}
    linked = Linkage(members, weights, 0.3)
    assert sum(len(linked.offers(name)) for name in linked.members) == len(members) - 1  # all pairs are 44,850
