"""Order-dependent merging of groups that may come together.

Which two groups merge next depends on the merges before, so groups that can reach each
other by merging have no parallel form; others do not see each other, and are merged
beside each other. Only pairs that may merge are held: those with a common member, or
with an edge between them. The strongest is the top of a heap, from which pairs of
groups that are gone are dropped when they come up, so a merge costs its own pairs and
memory grows with pairs, not with the square of the groups.

A merged group keeps the name of the first of the two, so every group is named by the
place in the list of the group that it grew from.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable
from itertools import chain
from math import fsum

import numpy as np


class Merger:
    """Groups in list order: the strongest pair merges, and the union moves to the end.

    Names grow with the order in the list, so a pair is two names in order.
    """

    def __init__(self, members: list[list[int]]):
        self.members = {name: sorted(set(m)) for name, m in enumerate(members)}
        #: the place of the group that each one grew from
        self.first = {name: name for name in self.members}
        self.holders: dict[int, set[int]] = {}
        for name, group in self.members.items():
            for m in group:
                self.holders.setdefault(m, set()).add(name)

    def near(self, name: int) -> set[int]:
        """Groups that may merge with ``name``."""
        raise NotImplementedError

    def strength(self, a: int, b: int) -> float | None:
        """What a pair that may merge is worth, or None; asked once for each pair."""
        raise NotImplementedError

    def merged(self, a: int, b: int, name: int) -> None:
        """Called when ``name`` has become the union of two groups, before those are gone."""

    def settled(self, name: int, best: float) -> None:
        """Called when the pairs of ``name`` are known."""

    def offers(self, name: int) -> list[tuple[float, int, int]]:
        """The pairs of ``name`` with earlier groups, as they go into the heap."""
        made = [(o, name) for o in sorted(self.near(name)) if o < name]
        return [(-s, a, b) for a, b in made if (s := self.strength(a, b)) is not None and s > 0]

    def lost(self, name: int) -> list[tuple[float, int, int]]:
        """What ``name`` offers when the earlier group of its pair is gone."""
        return []

    def run(self) -> list[tuple[int, list[int]]]:
        """The place a group grew from and its members, for each group that is left, in list order."""
        heap = [offer for name in self.members for offer in self.offers(name)]
        heapq.heapify(heap)
        last = len(self.members) - 1
        while heap:
            best, a, b = heapq.heappop(heap)  # of equal strengths the first in list order
            if a not in self.members or b not in self.members:
                for offer in self.lost(b) if b in self.members else ():
                    heapq.heappush(heap, offer)
                continue
            last = name = last + 1
            self.members[name] = sorted({*self.members[a], *self.members[b]})
            self.first[name] = self.first[a]
            self.merged(a, b, name)
            for old in (a, b):
                for m in self.members.pop(old):
                    self.holders[m].discard(old)
            for m in self.members[name]:
                self.holders[m].add(name)
            for offer in self.offers(name):
                heapq.heappush(heap, offer)
            self.settled(name, -best)
        return [(self.first[name], self.members[name]) for name in sorted(self.members)]


class Linkage(Merger):
    """Total weight between two groups, if every member's mean reaches a threshold.

    Weights are symmetric. What a pair is worth depends on its two groups only, so each
    group offers just its best pair with an earlier one, and looks for another when that
    one is gone: memory grows with groups and edges, not with pairs. Above a threshold of 0
    a group may merge only if all its members have weight enough to the other side, so
    groups are looked up by their first two members among those that have.
    """

    def __init__(self, members: list[list[int]], weights: dict[tuple[int, int], float], threshold: float):
        super().__init__(members)
        self.threshold = threshold
        self.weights: dict[int, dict[int, float]] = {}
        for (a, b), w in weights.items():
            self.weights.setdefault(a, {})[b] = w
        #: groups by their first member and then the second, if any
        self.begun: dict[int, dict[int | None, set[int]]] = {}
        for name in self.members:
            self._add(name)

    def _totals(self, name: int) -> dict[int, float]:
        """The weight of all members to each node that they have edges with."""
        parts: dict[int, list[float]] = {}
        for m in self.members[name]:
            for node, w in self.weights.get(m, {}).items():
                parts.setdefault(node, []).append(w)
        return {node: fsum(ws) for node, ws in parts.items()}

    def _add(self, name: int) -> None:
        first, second = (*self.members[name], None)[:2]
        self.begun.setdefault(first, {}).setdefault(second, set()).add(name)

    def _drop(self, name: int) -> None:
        first, second = (*self.members[name], None)[:2]
        self.begun[first][second].discard(name)
        if not self.begun[first][second]:
            del self.begun[first][second]

    def _candidates(self, name: int, totals: dict[int, float]) -> Iterable[int]:
        """Groups that may merge with ``name``: above a threshold of 0 those of members that all have weight enough."""
        if self.threshold <= 0:
            return set().union(*(self.holders.get(node, ()) for node in totals))
        size = len(self.members[name])
        nodes = {node for node, s in totals.items() if s / size >= self.threshold}
        seconds = {*nodes, None}
        met = (self.begun[node][k] for node in nodes & self.begun.keys() for k in self.begun[node].keys() & seconds)
        return [o for o in chain.from_iterable(met) if len(self.members[o]) < 3 or nodes.issuperset(self.members[o])]

    def merged(self, a: int, b: int, name: int) -> None:
        self._drop(a)
        self._drop(b)
        self._add(name)

    def offers(self, name: int) -> list[tuple[float, int, int]]:
        totals, own = self._totals(name), [self.weights.get(m, {}) for m in self.members[name]]
        size, best = len(own), None
        for o in self._candidates(name, totals):
            if o >= name:
                continue
            other = self.members[o]
            theirs = [totals.get(m, 0.0) for m in other]
            mine = [fsum(edges[m] for m in other if m in edges) for edges in own]
            if min(mine) / len(other) < self.threshold or min(theirs) / size < self.threshold:
                continue
            strength = fsum(theirs + mine)
            if strength > 0 and (best is None or (-strength, o) < best):
                best = (-strength, o)
        return [] if best is None else [(best[0], best[1], name)]

    def lost(self, name: int) -> list[tuple[float, int, int]]:
        return self.offers(name)


class Attachment(Merger):
    """Mean of two groups' values, if each shares enough members with the other.

    A group's value is its itemset's length, and after a merge the strength of that
    merge, kept at the first of the two. ``position`` looks the value up by a group's
    place in the list, which moves as groups merge; ``id`` by the group itself.
    """

    def __init__(self, members: list[list[int]], lengths: list[float], threshold: float, index: str = "position"):
        if index not in ("position", "id"):
            raise ValueError("index is position or id")
        super().__init__(members)
        self.threshold, self.index = threshold, index
        self.values = np.array(lengths, float)
        #: where the value of a group stands: its own number, or that of the first group in it
        self.slot = {name: name for name in self.members}
        self.listed: list[int] = []

    def names(self) -> list[int]:
        """The groups in list order; names only grow, so a list of other length or end is an old one."""
        if len(self.listed) != len(self.members) or self.listed[-1] not in self.members:
            self.listed = sorted(self.members)
        return self.listed

    def near(self, name: int) -> set[int]:
        if self.threshold <= 0:
            return set(self.members) - {name}
        return set().union(*(self.holders[m] for m in self.members[name])) - {name}

    def strength(self, a: int, b: int) -> float | None:
        one, other = self.members[a], self.members[b]
        shared = len(set(one) & set(other))
        if shared / len(one) < self.threshold or shared / len(other) < self.threshold:
            return None
        if self.index == "position":
            names = self.names()
            x, y = bisect_left(names, a), bisect_left(names, b)
        else:
            x, y = self.slot[a], self.slot[b]
        return float(self.values[x] + self.values[y]) / 2.0

    def merged(self, a: int, b: int, name: int) -> None:
        self.slot[name] = self.slot.pop(a)
        del self.slot[b]

    def settled(self, name: int, best: float) -> None:
        self.values[self.slot[name]] = best


def _members(groups: list[tuple[int, list[int]]]) -> list[list[int]]:
    return [members for _, members in groups]


def merge_by_connections(cliques: list[list[int]], connected: set[tuple[int, int]], threshold: float) -> list[list[int]]:
    return _members(Linkage(cliques, {pair: 1.0 for pair in connected}, threshold).run())


def merge_by_weight(cliques: list[list[int]], weights: dict[tuple[int, int], float], threshold: float) -> list[list[int]]:
    return _members(Linkage(cliques, weights, threshold).run())


def merge_by_attachment(cliques: list[list[int]], lengths: list[float], threshold: float, index: str = "position") -> list[list[int]]:
    return _members(Attachment(cliques, lengths, threshold, index).run())


class DirectedMerger:
    """Nodes merged along edges read from the earlier group to the later.

    The first group, in list order, with an edge from a member to one of a later group
    merges with the first such group, and the union moves to the end. Besides single
    edges there are groups whose members have edges to all larger ones of theirs. A
    group without a way on is looked at again when one that it has an edge to has moved.
    """

    def __init__(self, nodes: list[int], edges: set[tuple[int, int]], attached: list[list[int]] = ()):
        self.members = {name: [node] for name, node in enumerate(sorted(nodes))}
        self.first = {name: m[0] for name, m in self.members.items()}
        self.group = {m[0]: name for name, m in self.members.items()}
        self.out: dict[int, list[list[int]]] = {}
        self.into: dict[int, list[list[int]]] = {}
        for a, b in edges:
            if a != b and a in self.group and b in self.group:
                self.out.setdefault(a, [[]])[0].append(b)
                self.into.setdefault(b, [[]])[0].append(a)
        self.attached = [sorted(m) for m in attached]
        self.held: dict[int, list[int]] = {}
        for k, own in enumerate(self.attached):
            for m in own:
                self.held.setdefault(m, []).append(k)

    def _targets(self, node: int) -> set[int]:
        """The groups that a node has edges to."""
        more = (m for k in self.held.get(node, ()) for m in self.attached[k][bisect_left(self.attached[k], node) + 1 :])
        return {self.group[m] for part in (*self.out.get(node, ()), more) for m in part}

    def _sources(self, node: int) -> set[int]:
        more = (m for k in self.held.get(node, ()) for m in self.attached[k][: bisect_left(self.attached[k], node)])
        return {self.group[m] for part in (*self.into.get(node, ()), more) for m in part}

    def _partner(self, name: int) -> int | None:
        for member in self.members[name]:
            later = [g for g in self._targets(member) if g > name]
            if later:
                return min(later)
        return None

    def run(self) -> list[tuple[int, list[int]]]:
        """The node a group grew from and its members, for each group of two or more."""
        waiting = list(self.members)
        last = len(waiting) - 1
        while waiting:
            name = heapq.heappop(waiting)
            other = self._partner(name) if name in self.members else None
            if other is None:
                continue
            last += 1
            self.first[last] = self.first[name]
            self.members[last] = sorted(self.members.pop(name) + self.members.pop(other))
            for m in self.members[last]:
                self.group[m] = last
            for source in {g for m in self.members[last] for g in self._sources(m)} - {last}:
                heapq.heappush(waiting, source)
        return [(self.first[name], m) for name, m in sorted(self.members.items()) if len(m) > 1]


def directed_components(nodes: list[int], edges: set[tuple[int, int]]) -> list[list[int]]:
    return _members(DirectedMerger(nodes, edges).run())
