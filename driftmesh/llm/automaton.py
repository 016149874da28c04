"""Cheapest edits that bring a sequence of roles into an allowed form.

The edits form a weighted automaton over four states: nothing yet, after the system's
row, after a user's, after an assistant's. Read from the last row to the first, the
costs of finishing from each state are a vector; less its smallest entry there are few
of them, and each becomes a state of a deterministic automaton when it is first met.
Its moves are cached, so a sequence costs one lookup a row. The edits themselves are
read the other way, over arcs that are tight (what they cost is what the costs of their
ends differ by), the least letter first; that is a cached lookup a row too.
"""

from __future__ import annotations

from collections.abc import Sequence

#: What has been put out so far: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The role that may come next by an edit, and so the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
ENDS = (START, ASSISTANT)
RELABEL, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Symbols of rows: one that must go, or twice the row's initial (others: 0) and whether it is cut short.
GONE = 0
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

Vector = tuple[int, ...]


def symbol(role: str, must_go: bool, cut_short: bool) -> int:
    return GONE if must_go else 1 + 2 * INITIALS.get(role[:1], 0) + cut_short


def _arcs(row: int, state: int) -> list[tuple[str, int, int]]:
    """letter, state after, cost of the edits that take a row from a state."""
    found = [("D", state, DELETE)]
    if row != GONE:
        initial, short = divmod(row - 1, 2)
        extra = CUT_SHORT * short
        if initial and (initial == NEXT[state] or (initial, state) == (SYSTEM, START)):
            found.append(("K", initial, extra))
        found.append(("R", NEXT[state], RELABEL + extra))
    return found


def _closed(costs: Sequence[int]) -> Vector:
    """Costs when rows may be put in as well; two of them in a row lead back to where they began."""
    once = [min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES]
    return tuple(min(once[q], INSERT + once[NEXT[q]]) for q in STATES)


def before_row(row: int, after: Vector) -> Vector:
    """Costs of finishing from each state, with ``row`` still to come."""
    return _closed([min(cost + after[q] for _, q, cost in _arcs(row, state)) for state in STATES])


#: Costs when no row is left.
END = _closed([0 if q in ENDS else 1_000_000 for q in STATES])


def _path(state: int, now: Vector, after: Vector | None, row: int = GONE) -> tuple[str, int]:
    """The least letters on tight arcs from a state until a row is taken (or the end reached), and the state then."""
    letters = ""
    while True:
        tight = [("I", NEXT[state], False)] if now[state] == INSERT + now[NEXT[state]] else []
        if after is not None:
            tight += [(letter, q, True) for letter, q, cost in _arcs(row, state) if now[state] == cost + after[q]]
        elif not now[state]:
            return letters, state
        letter, state, taken = min(tight)
        letters += letter
        if taken:
            return letters, state


class Costs:
    """The deterministic automaton, made as far as rows have asked for it."""

    def __init__(self):
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        #: number of the vector after a row, the row -> number before it, what was taken off, and the path from each state
        self.moves: dict[tuple[int, int], tuple[int, int, tuple[tuple[str, int], ...]]] = {}
        self.end = self.number(END)
        self.last = tuple(_path(q, END, None) for q in STATES)

    def number(self, vector: Vector) -> int:
        """The state of a vector whose smallest entry is 0."""
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    def move(self, after: int, row: int) -> tuple[int, int, tuple[tuple[str, int], ...]]:
        found = self.moves.get((after, row))
        if found is None:
            full = before_row(row, self.vectors[after])
            least = min(full)
            paths = tuple(_path(q, full, self.vectors[after], row) for q in STATES)
            found = self.moves[after, row] = (self.number(tuple(c - least for c in full)), least, paths)
        return found

    def scan(self, rows: Sequence[int], after: int) -> tuple[list[tuple[tuple[str, int], ...]], int, int]:
        """From the last row to the first: the paths of each row, the number before the first, the sum taken off."""
        paths, total = [], 0
        for row in reversed(rows):
            after, less, path = self.move(after, row)
            paths.append(path)
            total += less
        return paths[::-1], after, total

    def cheapest(self, rows: Sequence[int]) -> tuple[int, list[tuple[str, int]]]:
        """The least cost and, for each row and the end, the letters and the state after them."""
        paths, first, total = self.scan(rows, self.end)
        state, found = START, []
        for path in [*paths, self.last]:
            found.append(path[state])
            state = path[state][1]
        return total + self.vectors[first][START], found


def span(rows: Sequence[int]) -> list[list[int]]:
    """Least costs of the edits of some rows, from each state to each; what is put in after the last row is not in it."""
    far = 1_000_000_000
    return [list(column) for column in zip(*[_span_to(rows, [0 if q == to else far for q in STATES]) for to in STATES], strict=True)]


def _span_to(rows: Sequence[int], costs: Sequence[int]) -> Sequence[int]:
    for row in reversed(rows):
        costs = before_row(row, tuple(costs))
    return costs
