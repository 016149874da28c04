"""Cutting byte strings so that equal windows end up under equal keys.

The minimizer of a window is its grain (a short substring) of smallest hash.
Equal windows have equal minimizers at equal places, so neighbouring windows with
one minimizer form a segment, and any two equal windows of different texts lie in
segments with the same key.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

GRAIN = 16
_PLACE_BITS = 30


class Segments(NamedTuple):
    """Per segment: the text it is from, first byte, end and grain in that text, and key."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    grain: np.ndarray
    key: np.ndarray


def no_segments() -> Segments:
    none = np.zeros(0, np.int64)
    return Segments(none, none, none, none, none.astype(np.uint64))


def _grain_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at every position but the last 15."""
    n = len(data) - GRAIN + 1
    words = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    mixed = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed += words[8:]
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def segments(texts: list[bytes], window: int) -> Segments:
    """The segments of all windows of ``window`` bytes of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    n_windows = np.maximum(lengths - window + 1, 0)
    if not n_windows.sum():
        return no_segments()
    hashes = _grain_hashes(np.frombuffer(b"".join(texts), np.uint8))
    # the hash decides, then the place: of equal grains the first is taken
    least = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    grains, width = window - GRAIN + 1, 1
    while 2 * width <= grains:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < grains:
        least = np.minimum(least[: len(least) - (grains - width)], least[grains - width :])
    # windows that lie in one text
    text = np.repeat(np.arange(len(texts)), n_windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + begins[text]
    place = (least[start] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(start)) - 1
    owner = text[first]
    at, end, grain = start[first], start[last] + window, place[first]
    return Segments(owner, at - begins[owner], end - begins[owner], grain - begins[owner], hashes[grain])
