"""Binary fuse filters: a static set of 64-bit keys in about nine bits each.

A key is in the set if the bytes in its three places combine to its fingerprint, which
holds for every key of the set and for one in 256 others. Places lie in three
neighbouring segments, so that keys can be taken off one by one, each by a place that no
other key left has; taken in the reverse order, each then sets that place. Keys that can
be taken off at the same time are, so building is a few array operations a round. The
construction is that of Graf and Lemire (Binary Fuse Filters, 2022).
"""

from __future__ import annotations

import math

import numpy as np

MAX_SEEDS = 100
_HEAD = np.dtype([("seed", "<u8"), ("segment", "<u4"), ("segments", "<u4")])


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of a 64-bit hash over keys moved by a seed."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """``BinaryFuse.of(keys)``, then ``contains(keys)``; ``dump`` and ``load`` as bytes."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Three places of each hash, in three segments one after the other."""
        span, mask = np.uint64(self.segments * self.segment), np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third], axis=1).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray) -> BinaryFuse:
        """A filter of the distinct ``keys`` (any 64-bit integers)."""
        keys = np.unique(keys.astype(np.int64, copy=False).view(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, MAX_SEEDS + 1):
            made = cls(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
        raise RuntimeError(f"no filter of {len(keys)} keys in {MAX_SEEDS} trials")

    def _fill(self, keys: np.ndarray) -> bool:
        h = _mixed(keys, self.seed)
        places, prints = self._places(h), self._prints(h)
        held = np.bincount(places.ravel(), minlength=len(self.cells))
        named = np.zeros(len(self.cells), np.int64)  # of a place that one key holds, that key
        np.add.at(named, places.ravel(), np.repeat(np.arange(len(keys)), 3))
        rounds, left = [], len(keys)
        lone = np.flatnonzero(held == 1)
        while len(lone):
            taken, at = np.unique(named[lone], return_index=True)
            rounds.append((taken, lone[at]))
            left -= len(taken)
            freed = places[taken].ravel()
            np.subtract.at(held, freed, 1)
            np.subtract.at(named, freed, np.repeat(taken, 3))
            lone = np.unique(freed[held[freed] == 1])
        if left:
            return False
        for taken, at in reversed(rounds):
            around = np.bitwise_xor.reduce(self.cells[places[taken]], axis=1)
            self.cells[at] = prints[taken] ^ around ^ self.cells[at]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys.astype(np.int64, copy=False).view(np.uint64), self.seed)
        return np.bitwise_xor.reduce(self.cells[self._places(h)], axis=1) == self._prints(h)

    def dump(self) -> bytes:
        return np.array((self.seed, self.segment, self.segments), _HEAD).tobytes() + self.cells.tobytes()

    @classmethod
    def load(cls, data: bytes) -> BinaryFuse:
        head = np.frombuffer(data, _HEAD, 1)[0]
        return cls(int(head["seed"]), int(head["segment"]), int(head["segments"]), np.frombuffer(data, np.uint8, offset=_HEAD.itemsize))
