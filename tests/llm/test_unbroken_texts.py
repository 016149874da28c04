"""Token counts and budgets on long texts without a break, and against a slow search on short ones."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftmesh.llm.bpe import WHITE, PrefixCounter, PrefixIndex

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def test_white_space_is_spelt_out():
    assert len(WHITE) == 25 and "-" not in WHITE and " " in WHITE


@pytest.mark.parametrize("kind", ["letter", "blanks", "breaks", "letters", "digits", "marks", "accents"])
def test_a_megabyte(counter, kind):
    rng = random.Random(1)
    one = {"letter": "a", "blanks": " ", "breaks": "\n\t", "digits": "7", "marks": "-=", "accents": "é"}
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)) if kind == "letters" else one[kind] * (1_000_000 // len(one[kind]))
    begin = time.perf_counter()
    total, fit = counter.measure(text, 512)
    assert time.perf_counter() - begin < 60
    part = text[:20_000]
    assert counter.total(part) == len(Tokenizer.from_file(PATH).encode(part, add_special_tokens=False).ids)
    index = PrefixIndex(counter, text[: fit + 40])
    assert total > 512 and index.count(fit) <= 512 and all(index.count(fit + k) > 512 for k in range(1, 40))


@pytest.mark.parametrize("seed", range(40))
def test_budgets_by_trying_all_prefixes(counter, seed):
    rng = random.Random(seed)
    bits = ["a", "the", "'", "'ll", "'re", " ", "  ", "\n", "\t", " ", "7", "42", "é", "日", "!", "--", "<|endoftext|>", "<|end", "s", "x" * 30]
    text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
    index = PrefixIndex(counter, text)
    counts = [index.count(k) for k in range(len(text) + 1)]
    for budget in range(max(counts) + 2):
        assert index.longest(budget) == max(k for k, n in enumerate(counts) if n <= budget)
        assert counter.measure(text, budget) == (counts[-1], index.longest(budget))


def test_texts_are_counted_by_parts_unless_a_space_follows_a_blank(counter):
    dice = random.Random(11)
    encoder = Tokenizer.from_file(PATH)
    assert counter.units("Ab, cd\nef\xa0g h") == ["Ab,", " cd\nef\xa0g", " h"]
    assert all(counter.units(f"a{blank} b") is None for blank in WHITE)
    for _ in range(400):
        text = "".join(dice.choice(["a", "the", "Zqx", "9", "'s", ".", "é", " ", " ", *WHITE]) for _ in range(dice.randint(1, 14)))
        assert counter.total(text) == len(encoder.encode(text, add_special_tokens=False).ids), text
