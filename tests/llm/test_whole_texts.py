"""Long texts are judged by all of their letters."""

from driftmesh.llm import quality


def test_script_counts_all_letters():
    # every second character is a Latin letter, which is what a stride of two sees
    assert quality.script("aя" * 3000 + "я" * 2192) == "cyrillic"
    assert quality.script("aя" * 3000 + "a" * 2192) == "latin"
