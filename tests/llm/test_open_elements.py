"""End tags find their opener however many elements stand open."""

import pytest

from driftmesh.llm import markup


@pytest.mark.parametrize("n", [10, 64, 500])
def test_end_tag_of_a_far_opener(n):
    items = "".join(f"<li><b>x{k}" for k in range(n))
    blocks, zones = markup.page_blocks(f"<nav>{items}</nav><div>story</div>")
    assert blocks[-1] == "story" and zones[-1] == markup.OTHER
    bold = "<b>x " * n
    blocks, zones = markup.page_blocks(f"<article><p>{bold}</article><div>after</div>")
    assert blocks[-1] == "after" and zones[-1] == markup.OTHER
