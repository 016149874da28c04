"""Segments that share no window are kept out of the index, and large indexes sort as small ones do."""

import numpy as np

from driftmesh.llm import runindex, substrings
from driftmesh.llm.minimizers import GRAIN
from driftmesh.llm.runindex import RunIndex


def _around(rng, grain: bytes, before: int, after: int) -> bytes:
    return bytes(rng.integers(97, 99, before, np.uint8)) + grain + bytes(rng.integers(97, 99, after, np.uint8))


def test_half_a_window_is_not_enough():
    grain = bytes(range(GRAIN))
    texts = [b"a" * 17 + grain + b"same seventeen by" + b"a" * 9, b"b" * 17 + grain + b"same seventeen by" + b"b" * 9]
    assert len(substrings._may_share(np.arange(2), texts, np.full(2, 17), 50)) == 0


def test_no_segment_that_shares_a_window_is_left_out():
    rng, grain = np.random.default_rng(5), b"0123456789abcdef"
    for length in (20, 24, 33, 50, 70):
        rest = length - GRAIN
        before = rng.integers(0, rest + 1, 120)
        # the ends nearest to the grain are drawn from a few, so that many meet
        cores = [(_around(rng, b"", rest, 0), _around(rng, b"", 0, rest)) for _ in range(4)]
        texts, at = [], []
        for b in before.tolist():
            left, right = cores[rng.integers(4)][0], cores[rng.integers(4)][1]
            text = left[rest - b :] + grain + right[: int(rng.integers(rest - b, rest + 1))]
            texts.append(text), at.append(b)
        texts, first = list(dict.fromkeys(texts)), {t: a for t, a in zip(texts, at, strict=True)}
        windows: dict[tuple[int, bytes], int] = {}
        for text in texts:
            for low in range(max(0, first[text] - rest), min(first[text], len(text) - length) + 1):
                windows[first[text] - low, text[low : low + length]] = windows.get((first[text] - low, text[low : low + length]), 0) + 1
        must = {
            k
            for k, text in enumerate(texts)
            for low in range(max(0, first[text] - rest), min(first[text], len(text) - length) + 1)
            if windows[first[text] - low, text[low : low + length]] > 1
        }
        found = substrings._may_share(np.arange(len(texts)), texts, np.array([first[t] for t in texts]), length)
        assert must and must <= set(found.tolist())


def test_index_sorts_alike_with_and_without_packing(monkeypatch):
    rng = np.random.default_rng(9)
    texts = list(dict.fromkeys(bytes(rng.integers(97, 99, 60, np.uint8)) for _ in range(200)))
    texts += [t[:30] + b"x" + t[:29] for t in texts[:50]] + [b"a" * 60, b"a" * 59 + b"b"]
    owners = np.arange(len(texts))[::-1].copy()
    made = [c[np.lexsort((index[1], index[0]))].tolist() for index in [RunIndex(texts, owners, 20).stream()] for c in index]
    monkeypatch.setattr(runindex, "_ranked_pairs", lambda high, low, limit: runindex._ranked(high * (limit + 1) + low))
    plain = [c[np.lexsort((index[1], index[0]))].tolist() for index in [RunIndex(texts, owners, 20).stream()] for c in index]
    assert made == plain
    first: dict[bytes, int] = {}
    for text, owner in zip(texts, owners.tolist(), strict=True):
        for low in range(41):
            if len(text) >= low + 20:
                key = text[low : low + 20]
                first[key] = min(first.get(key, owner), owner)
    assert all(first[texts[t][p : p + 20]] == o for t, p, o in zip(*made, strict=True))
