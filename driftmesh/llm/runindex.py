"""A run-length index of many byte strings, and streaming through it.

The texts are joined with separators that differ from each other, their suffixes
sorted, and the Burrows-Wheeler transform is kept as its runs only: a symbol, a
first row, and the row that the first row leads to. All rows of a run lead to
neighbouring rows, so a backward step costs one lookup of the row's run. The suffix
array is dropped but for samples at run ends, from which rows can be located. Rows
whose suffixes share ``depth`` bytes form a group, of which the smallest owner is
kept. A text streamed backwards through the index stands, at each of its places,
in the row of its own suffix: if that row's group has a smaller owner, the text's
match with earlier owners is at least ``depth`` long there.
"""

from __future__ import annotations

import numpy as np


def _ranked(order_key: np.ndarray) -> np.ndarray:
    return np.unique(order_key, return_inverse=True)[1].astype(np.int64)


def _ranked_pairs(high: np.ndarray, low: np.ndarray, limit: int) -> np.ndarray:
    """Ranks of pairs of numbers from 0 to ``limit``; where pair and place fit in 63 bits they are sorted as one number."""
    size, bits, more = len(high), limit.bit_length(), len(high).bit_length()
    if 2 * bits + more > 63:
        return _ranked(high * (limit + 1) + low)
    packed = (high << bits | low) << more | np.arange(size)
    packed.sort()
    pair, place = packed >> more, packed & ((1 << more) - 1)
    rank = np.empty(size, np.int64)
    rank[place] = np.append(0, np.cumsum(pair[1:] != pair[:-1]))
    return rank


class RunIndex:
    """Built from byte strings without their owners' ids repeating in one string."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, depth: int):
        self.depth, n = depth, len(texts)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        # separators are 0 .. n-1, bytes follow; the last text ends with one too
        ends = np.cumsum(self.lengths + 1) - 1
        symbols = np.full(int(ends[-1]) + 1, -1, np.int64)
        symbols[ends] = np.arange(n)
        symbols[symbols < 0] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + n
        owner = np.repeat(np.asarray(owners, np.int64), self.lengths + 1)
        rank, width, half = self._sort(symbols)
        rows = np.empty_like(rank)  # the suffix array
        rows[rank] = np.arange(len(rank))
        group = self._groups(rank, width, half)[rows]
        new = np.append(True, group[1:] != group[:-1])
        self.group_owner = np.minimum.reduceat(owner[rows], np.flatnonzero(new))
        self.group_of = np.cumsum(new, dtype=np.int32) - 1
        bwt = symbols[rows - 1]  # before the first symbol comes the last, a separator
        new = np.append(True, bwt[1:] != bwt[:-1])
        #: how many run heads stand before each row: a lookup instead of a search
        self.run_of = np.cumsum(new, dtype=np.int32) - 1
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(bwt)))
        self.run_start, self.run_symbol = head, bwt[head]
        # runs of one symbol lead to the rows that begin with it, in order
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        leads = np.empty(len(head), np.int64)
        leads[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
        self.run_leads = leads
        self.run_end_sample = rows[head + size - 1]
        self.n_rows = len(bwt)

    def _sort(self, symbols: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        """Ranks of all suffixes, and those by the last power of two within ``depth`` symbols."""
        size = len(symbols)
        rank, width, limit = symbols, 1, int(symbols.max()) + 1  # symbols are in order, though not dense
        half, half_width, distinct = rank, 1, False
        while not distinct:
            after = np.zeros(size, np.int64)
            after[: size - width] = rank[width:] + 1
            rank, limit = _ranked_pairs(rank, after, limit), size
            width *= 2
            if width <= self.depth:
                half, half_width = rank, width
            distinct = int(rank.max()) == size - 1
        return rank, half_width, half

    def _groups(self, rank: np.ndarray, width: int, half: np.ndarray) -> np.ndarray:
        """Equal numbers where the first ``depth`` symbols are equal."""
        if 2 * width < self.depth:  # all suffixes differ earlier
            return rank
        size, gap = len(rank), self.depth - width
        after = np.zeros(size, np.int64)
        after[: size - gap] = half[gap:] + 1
        return _ranked_pairs(half, after, max(size, int(half.max()) + 1))

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one symbol earlier."""
        run = self.run_of[rows]
        return self.run_leads[run] + rows - self.run_start[run]

    def locate(self, row: int) -> int:
        """The text position of a row's suffix: step back to a run's end, then count."""
        steps = 0
        while True:
            run = int(self.run_of[row])
            end = self.run_start[run + 1] - 1 if run + 1 < len(self.run_start) else self.n_rows - 1
            if row == end:
                return int(self.run_end_sample[run] + steps) % self.n_rows
            row = int(self.run_leads[run] + row - self.run_start[run])
            steps += 1

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, owner) of every window of ``depth`` bytes: its smallest owner."""
        text = np.arange(len(self.lengths))
        row, place = text.copy(), self.lengths.copy()  # the rows of the separators
        found: list[tuple[np.ndarray, ...]] = []
        while len(text):
            row, place = self.back(row), place - 1
            there = place >= 0
            text, row, place = text[there], row[there], place[there]
            deep = place <= self.lengths[text] - self.depth
            found.append((text[deep], place[deep], self.group_owner[self.group_of[row[deep]]]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))
