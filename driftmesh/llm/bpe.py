"""Exact byte-pair token counts at every prefix of a text.

Two neighbouring tokens can stand side by side in an encoding exactly when no
merge across their border would have come before the merges that built them, and
a sequence of tokens is the encoding of its bytes exactly when all neighbours can.
So the last token of the encoding of each prefix follows from those of shorter
prefixes, and the count at a prefix is one more than the count where its last
token starts. One pass over a word's bytes gives the counts at all its prefixes;
a text adds them up over the words that the vocabulary's pattern cuts it into.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick

#: How byte-level vocabularies cut texts into words, and the characters of White_Space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), BLANKS, flags=re.DOTALL)
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: Words remembered with their counts, parts of texts with their number, and characters of a word that is remembered, per worker.
MEMORY, PARTS, SHORT = 400_000, 1_000_000, 1_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def word_pattern() -> re.Pattern:
    """``PATTERN`` with the Unicode letters and numbers as character sets."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for point in range(sys.maxunicode + 1):
        kind = runs.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            if kind and kind[-1][1] == point - 1:
                kind[-1][1] = point
            else:
                kind.append([point, point])
    sets = {name: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found) for name, found in runs.items()}
    return re.compile(PATTERN.format(S=BLANKS, **sets))


class PrefixCounter:
    """Counts of tokens for a byte-level BPE file with the standard pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        if model["type"] != "BPE" or spec["normalizer"] or not plain or model["ignore_merges"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        alphabet = byte_alphabet()
        decode = lambda token: bytes(alphabet[c] for c in token)
        added = [t["content"] for t in spec["added_tokens"]]
        # a token is named by the rank of its merge; bytes come first
        self.token = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"], 256):
            left, right = (decode(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            pair = (self.token[left], self.token[right])
            self.token.setdefault(left + right, rank)
            self.merged.setdefault(pair, rank)
            self.parts.append(pair)
        self.tokens = ahocorasick.Automaton()
        for token, rank in self.token.items():
            self.tokens.add_word(token.decode("latin-1"), (rank, len(token)))
        self.tokens.make_automaton()
        self.pattern = word_pattern()
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words: dict[str, bytes | array] = {}
        self.known: dict[str, int] = {}
        #: a blank with a space after it: only such a space may be within a word
        self.blanks_meet = re.compile(f"[{BLANKS}] ")
        self.stable: dict[int, bool] = {}

    def _stable(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the tokens are built."""
        parts, merged, limit = self.parts, self.merged, len(self.parts)
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                # until its last merge, the left token ended in its second part
                limit, split = left, parts[left]
                left = split[1] if split else left
            else:
                # merges of one rank run from left to right: an equal one would win
                limit, split = right + 1, parts[right]
                right = split[0] if split else right
            if split is None:
                return True

    def word(self, word: str) -> bytes | array:
        """Counts at the prefixes of 0, 1, 2 ... bytes of one word."""
        if len(word) > SHORT:
            return self._count(word)
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMORY:
                self.words.clear()
            found = self.words[word] = self._count(word)
        return found

    def _count(self, word: str) -> bytes | array:
        # a character for each byte, as the automaton holds the tokens
        data = word if word.isascii() else word.encode().decode("latin-1")
        stable, base, size = self.stable, len(self.parts), len(data)
        counts, last, at = [0] * (size + 1), [-1] * (size + 1), -1
        for end, (token, length) in self.tokens.iter(data):
            if end == at:
                continue  # only one token can be the last
            start = end - length + 1
            if start:
                pair = last[start] * base + token
                fits = stable.get(pair)
                if fits is None:
                    if len(stable) >= 4 * MEMORY:
                        stable.clear()
                    fits = stable[pair] = self._stable(last[start], token)
                if not fits:
                    continue
            at = end
            last[end + 1], counts[end + 1] = token, counts[start] + 1
        return bytes(counts) if max(counts) < 256 else array("I", counts)

    def cut(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        words, at = [], 0
        for match in self.special.finditer(text):
            words += [*self.pattern.findall(text, at, match.start()), match[0]]
            at = match.end()
        return words + self.pattern.findall(text, at)

    def units(self, text: str) -> list[str] | None:
        """The text cut before every space, if each part can be counted on its own.

        The pattern lets a space be the first character of a word only, but in a run of
        blanks. So a text without a space that follows a blank has no word across a cut,
        and none of its parts but the last ends in a blank, whose word depends on what follows.
        """
        if self.blanks_meet.search(text) or (self.special is not None and self.special.search(text)):
            return None
        first, *rest = text.split(" ")
        return [first, *[" " + unit for unit in rest]]

    def unit(self, unit: str) -> int:
        """Tokens of one part of ``units``."""
        count = self.known.get(unit)
        if count is None and len(unit) > SHORT:
            return sum(self.word(w)[-1] for w in self.pattern.findall(unit))
        if count is None:
            if len(self.known) >= PARTS:
                self.known.clear()
            count = self.known[unit] = sum(self.word(w)[-1] for w in self.pattern.findall(unit))
        return count

    def total(self, text: str) -> int:
        """Tokens of the whole text: the count at its last prefix."""
        units = self.units(text)
        if units is None:
            return sum(1 if self.is_special(w) else self.word(w)[-1] for w in self.cut(text))
        return sum(map(self.unit, units))

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and characters of its longest prefix of at most ``budget``.

        Counts grow by one at least from unit to unit, so the longest prefix ends in
        the unit after the last one that fits; only that unit is looked at within.
        """
        units = self.units(text)
        if units is None:
            index = PrefixIndex(self, text)
            return index.total, index.longest(budget)
        ends = list(accumulate(map(self.unit, units)))
        if ends[-1] <= budget:
            return ends[-1], len(text)
        last = bisect_right(ends, budget)
        before = ends[last - 1] if last else 0
        return ends[-1], sum(map(len, units[:last])) + PrefixIndex(self, units[last]).longest(budget - before)

    def is_special(self, word: str) -> bool:
        return self.special is not None and self.special.fullmatch(word) is not None


class PrefixIndex:
    """Exact counts at all prefixes of one text: a count per word, and per byte within."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.words = counter.cut(text)
        self.starts = [0, *accumulate(map(len, self.words))]
        self.before = [0, *accumulate(self._size(w) for w in self.words)]
        self.total = self.before[-1]
        #: the last run of blanks looked at, and its counts
        self.run: tuple[int, int] | None = None
        self.run_counts: bytes | array = b""

    def _is_blank(self, at: int) -> bool:
        return re.match(f"[{BLANKS}]", self.text[at]) is not None

    def _size(self, word: str) -> int:
        return 1 if self.counter.is_special(word) else self.counter.word(word)[-1]

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters, as if the text ended there."""
        if chars <= 0:
            return 0
        if chars >= len(self.text):
            return self.total
        at = bisect_left(self.starts, chars)
        if self.starts[at] == chars:
            back = at - 1
        else:
            back = at = at - 1
            if self.counter.is_special(self.words[back]) and back and not self.counter.is_special(self.words[back - 1]):
                back -= 1  # a cut special string is ordinary text and may join the word before
        # blanks at the end of a text stay together, so start before all of them
        while back and self._is_blank(self.starts[back]) and self._is_blank(self.starts[back] - 1):
            back -= 1
        tail = self.counter.cut(self.text[self.starts[back] : chars])
        return self.before[back] + sum(map(self._size, tail))

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens; linear in the words about the border."""
        if self.total <= budget:
            return len(self.text)
        # a further word adds a token at least, regrouped blanks take back one at most
        stop = min(bisect_left(self.before, budget + 3), len(self.words))
        for at in range(stop - 1, -1, -1):
            for chars, count in self._within(at):
                if count <= budget:
                    return chars
        return 0

    def _within(self, at: int) -> Iterator[tuple[int, int]]:
        """Prefixes that end in a word, the longest first, and their counts.

        A word cut short is a word by itself, whose count the word's own counts hold, but
        for three kinds: blanks at the end of a text are one word with those before, and a
        contraction or special string that is cut is cut into words anew; those are short.
        """
        word, start = self.words[at], self.starts[at]
        end = start + len(word)
        if self.counter.is_special(word) or word in CONTRACTIONS:
            yield from ((chars, self.count(chars)) for chars in range(end, start, -1))
            return
        blanks = len(word) if not word.strip(WHITE) else int(word[0] in WHITE)
        if blanks < len(word):
            counts, size = self.counter.word(word), len(word.encode())
            for k in range(len(word), blanks, -1):
                yield start + k, self.before[at] + counts[size]
                size -= len(word[k - 1].encode())
        if blanks:
            first = at
            while first and not self.words[first - 1].strip(WHITE):
                first -= 1
            run = self.text[self.starts[first] : start + blanks]
            if (first, len(run)) != self.run:
                self.run, self.run_counts = (first, len(run)), self.counter.word(run)
            size = len(run.encode())
            for k in range(blanks, 0, -1):
                yield start + k, self.before[first] + self.run_counts[size]
                size -= len(word[k - 1].encode())
