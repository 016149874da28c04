"""Whole pages against a second, slow reading of the rules, and pages that are out of order."""

import random
import time
from html.parser import HTMLParser

import pytest

from driftmesh.llm import extraction, markup


class Slow(HTMLParser):
    """Blocks and zones of well-formed pages by the standard library's parser."""

    BLOCKS = {"div", "p", "h1", "li", "ul", "nav", "footer", "header", "article", "section", "aside", "form", "body", "html", "head", "title", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.found, self.text = [], [], ""

    def zone(self):
        zone = markup.OTHER
        for tag, attrs in self.path:
            if tag == "article" and zone != markup.CHROME:
                zone = markup.MAIN
            elif tag in {"nav", "aside", "footer", "form", "head"} or set((attrs.get("class") or "").split("-")) & {"ad", "comments", "menu", "cookie"} or (tag == "header" and zone != markup.MAIN):
                zone = markup.CHROME
        return zone

    def flush(self):
        if self.text.split():
            self.found.append((" ".join(self.text.split()), self.zone()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
            return
        if tag in self.BLOCKS:
            self.flush()
        self.path.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.path.pop()

    def handle_data(self, data):
        if self.path and self.path[-1][0] not in {"script", "style", "title"}:
            self.text += data


def slow_blocks(html):
    parser = Slow()
    parser.feed(html)
    parser.close()
    return parser.found


def slow_common(a, b):
    """Positions in ``a`` of a longest common subsequence, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    i, j, shared = len(a), len(b), set()
    while i and j:
        if best[i][j] == best[i][j - 1]:
            j -= 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            shared.add(i)
    return shared


def slow_text(html, other):
    own, mate = slow_blocks(html), slow_blocks(other) if other is not None else []
    shared = slow_common([t for t, _ in own], [t for t, _ in mate])
    article = [(i, t) for i, (t, z) in enumerate(own) if z == markup.MAIN]
    loose = [(i, t) for i, (t, z) in enumerate(own) if z == markup.OTHER]
    new = [(i, t) for i, t in loose if i not in shared]
    if not article:
        return "\n".join(t for _, t in new or loose)
    return "\n".join(t for _, t in sorted(article + new if mate else article))


def some_pages(seed=2, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma&amp;", "d&eacute;lta", "x &lt; y", "<b>bold</b>", "<i>it</i>", "z<br>z"])
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 12))) + rng.choice([".", "", "!"])
    common = [line() for _ in range(6)]
    body = lambda: f"<p>{rng.choice(common) if rng.random() < 0.3 else line()}</p>"
    pages = []
    for k in range(n):
        parts = [f"<div>{rng.choice(common)}</div>" for _ in range(rng.randrange(3))]
        parts += ["<nav><ul><li>Home</li><li>About us</li></ul></nav>"] * rng.randrange(2) + [f'<div class="ad">{line()}</div>'] * rng.randrange(2)
        story = "".join(body() for _ in range(rng.randint(0, 5)))
        parts.append(f"<article><h1>{line()}</h1>{story}<form>Name</form></article>" if rng.random() < 0.7 else story)
        parts += [f"<div>{line()}</div>"] * rng.randrange(2) + ['<section class="comments"><article><p>Nice one</p></article></section>'] * rng.randrange(2)
        parts += ["<script>if (a < b) { c = '</p>' }</script>", "<footer>All rights kept</footer>"]
        html = f"<html><head><title>t</title></head><body>{''.join(parts)}</body></html>"
        pages.append((k, f"http://h{k % 3}.net/{rng.randrange(50):02d}/{k:03d}", rng.choice(pages)[2] if pages and rng.random() < 0.1 else html))
    return pages


def slow_texts(pages):
    made, hosts = {}, {}
    for k, url, html in pages:
        host, _, path = url.partition("://")[2].partition("/")
        hosts.setdefault(host, []).append(("/" + path, k, html))
    for rows in hosts.values():
        rows.sort()
        for at, (_, k, html) in enumerate(rows):
            mate = at + 1 if at % 2 == 0 else at - 1
            mate = mate if mate < len(rows) else at - 1
            made[k] = slow_text(html, rows[mate][2] if mate >= 0 and len(rows) > 1 else None)
    return made


def test_whole_pages(spark):
    pages = some_pages()
    made = spark.createDataFrame(pages, "page_id long, url string, html string")
    expected = slow_texts(pages)
    for chunk_bytes in (600, 1 << 20):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract_text(made, chunk_bytes=chunk_bytes).collect()}
        assert got == {k: (t, len(t)) for k, t in expected.items()}


def test_the_partner_decides_beside_an_article():
    page = ["Site name", "Story begins", "A long sentence of the story.", "Read more", "Rest of the story"]
    zones = [markup.OTHER, markup.MAIN, markup.MAIN, markup.MAIN, markup.OTHER]
    assert extraction.main_text(page, zones, []) == "\n".join(page[1:4])
    assert extraction.main_text(page, zones, ["Site name", "Something else", "Read more"]) == "\n".join(page[1:])
    # of a copy, all beside the article is shared
    assert extraction.main_text(page, zones, page) == "\n".join(page[1:4])
    # however much of two articles is the same
    assert extraction.main_text(page, zones, page[:4]) == "\n".join(page[1:])


def test_pages_written_by_hand(spark):
    """The truth is what a reader would call the story, written down beside each page."""
    paper = "<body><div>The Paper</div><div class='main-nav'>News Sport</div>{}<div>Printed in the old town</div><div class='ad-box-2'>Buy {}</div></body>"
    stories = [
        ("<article><h1>Bees</h1><h2>Introduction</h2><p>They fly.</p><h2>Method</h2><p>We looked.</p></article>", "Bees\nIntroduction\nThey fly.\nMethod\nWe looked."),
        ("<article><h1>Wasps</h1><h2>Introduction</h2><p>They sting.</p><h2>Method</h2><p>We ran.</p></article><p>Corrected in May.</p>", "Wasps\nIntroduction\nThey sting.\nMethod\nWe ran.\nCorrected in May."),
        ("<div class='search-result'><p>The only story.</p></div>", "The only story."),
        ("<article class='share-story'><p>Told by readers.</p></article>", "Told by readers."),
        ("<article><div class='notice-board history'><p>A board of wood.</p></div><div class='share-buttons'>Send</div></article>", "A board of wood."),
        ("<article><p>Marks.</p><a href='x'>link</a> <b title=\"1 > 2\">bold</b></article>", "Marks.\nlink bold"),
        ("<p>First part.</p><section class='comments-list'><article><p>So nice</p></article></section><p>Second part.</p>", "First part.\nSecond part."),
        ("<main><header><h1>Heading</h1></header><p>Body &amp; soul.</p><div class='related'>More</div></main>", "Heading\nBody & soul."),
    ]
    pages = [(k, f"http://paper.net/{k}", paper.format(html, k)) for k, (html, _) in enumerate(stories)]
    got = {r["page_id"]: r["text"] for r in extraction.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: text for k, (_, text) in enumerate(stories)}


def test_one_open_quote_is_one_tags_matter():
    page = "<a href='x>link</a><p title=\"a > b\">c</p><p title=\"d > e\">f</p>"
    assert markup.page_blocks(page)[0] == ["link", "c", "f"]


@pytest.mark.parametrize("piece", ['<a b ', "<a b='", '<a b=">" ', "<p", "<!x", "</script ", "<li>x", "&amp;", "<", "</div>", "<b>", '<a "', "<!-", "<script></script ", "< a", "x=\"' <i "])
def test_malformed_pages_take_linear_time(piece):
    for tail in ("", ">", '">', "-->"):
        begin = time.perf_counter()
        markup.page_blocks("<article><p>story</p>" + piece * (1_000_000 // len(piece)) + tail)
        assert time.perf_counter() - begin < 20


def test_long_pages_are_whole(spark):
    lines = [f"sentence number {k} of a long page." for k in range(30_000)]
    html = "<body><div>Site</div><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body>"
    pages = [(1, "http://a.net/1", html), (2, "http://a.net/2", html.replace("sentence", "line")), (3, "http://a.net/3", None)]
    got = {r["page_id"]: r["text"] for r in extraction.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n".join(lines) and got[2] == got[1].replace("sentence", "line") and got[3] == ""


def test_names_beside_main():
    assert markup.page_blocks('<div class="main-header">Logo</div><div><p>story</p></div>') == (["Logo", "story"], [markup.CHROME, markup.OTHER])
    assert markup.page_blocks('<div id="main"><p>story</p></div>') == (["story"], [markup.MAIN])
    assert markup.page_blocks("<p title=it's>a</p><p title=\"a > b\">c</p>")[0] == ["a", "c"]
