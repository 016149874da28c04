"""Cutting HTML into text blocks and saying where on the page each one stands."""

from __future__ import annotations

import re
from html import unescape

#: Where a block stands: in the article, in page furniture, or neither.
MAIN, CHROME, OTHER = 0, 1, 2

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Element names by what they do to the text, and the words that name furniture.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "td", "th",
}
_SPACED = {"br", "td", "th"}
_FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "datalist", "template", "svg", "canvas", "object", "audio", "video", "map", "head"}
_ARTICLE = {"article", "main"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "sidebar",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "disqus", "replies", "share", "sharing", "social", "related",
    "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "pagination", "pager", "toolbar", "widget", "contentinfo", "complementary",
    "search",
}
_TOP_NAMES = {"header", "masthead", "banner", "topbar", "logo"}
_LAYOUT = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "group", "icon", "icons", "inner", "item", "items", "label", "left", "link",
    "links", "list", "main", "outer", "panel", "primary", "right", "row", "secondary", "section", "slot", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """The words of class, id and role, and those of them that may name furniture.

    A word names what an element is if it is the last part of a name, but for words of
    layout and numbers: ``ad``, ``top-ad`` and ``ad-box-2``, but not ``ad-story``.
    """
    words: set[str] = set()
    telling: set[str] = set()
    for mark in _MARKS.finditer(attributes):
        for name in (mark[1] or mark[2] or mark[3] or "").lower().split():
            parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
            words.update(parts)
            for part in reversed(parts):
                telling.add(part)
                if part not in _LAYOUT and not part.isdigit():
                    break
    return words, telling


class _Page:
    def __init__(self) -> None:
        self.blocks: list[str] = []
        self.zones: list[int] = []
        self.text: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.zone = OTHER

    def end_block(self) -> None:
        text = " ".join(unescape("".join(self.text)).split())
        if text:
            self.blocks.append(text)
            self.zones.append(self.zone)
        self.text.clear()

    def enter(self, tag: str, attributes: str) -> None:
        zone, (names, telling) = self.zone, _names(attributes) if attributes else (set(), set())
        named = bool(telling & _NAMES)
        if tag in _ARTICLE or ("main" in names and not names & _TOP_NAMES):
            # an unclosed menu does not swallow the article, a list of comments does
            closed = zone == CHROME and self.open and self.open[-1][0] not in {"aside", "section", "div"} and not named
            zone = MAIN if zone != CHROME or closed else CHROME
            zone = CHROME if named else zone
        elif tag in _FURNITURE or named or (zone != MAIN and (tag == "header" or telling & _TOP_NAMES)):
            zone = CHROME
        if zone != self.zone and tag in _INLINE:
            self.end_block()
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.zone))
        self.zone = zone

    def leave(self, tag: str) -> None:
        if not self.places.get(tag):
            return
        depth = self.places[tag][-1]
        if self.open[depth][1] != self.zone:
            self.end_block()
        self.zone = self.open[depth][1]
        for name, _ in self.open[depth:]:
            self.places[name].pop()
        del self.open[depth:]


class _Scanner:
    """Cuts a page into tags in one forward pass, however malformed it is."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        #: where quotes open from which on no tag ends
        self.dead: set[int] = set()

    def _past(self, mark: str, at: int) -> int:
        end = self.html.find(mark, at)
        return len(self.html) if end < 0 else end + len(mark)

    def _tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag stands; there is one after ``at``.

        A ``>`` in quotes does not end a tag, unless its quotes are never closed or no other
        ends it. The places that such a tag went through are kept, so none is tried twice.
        """
        here, passed = at, []
        while here <= self.last:
            stop = _STOP.search(self.html, here)
            if stop.start() in self.dead:
                break
            if not stop[1]:
                return stop.start()
            passed.append(stop.start())
            end = self.html.find(stop[1], stop.end())
            if end < 0:
                break
            here = end + 1
        self.dead.update(passed)
        return self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag or comment, which has no name."""
        while True:
            start = self.html.find("<", at)
            if start < 0:
                return None
            if self.html.startswith("<!--", start):
                return start, self._past("-->", start + 4), "", False, ""
            if self.html.startswith("<![CDATA[", start):
                return start, self._past("]]>", start), "", False, ""
            if start > self.last:
                return None  # what follows is text
            if self.html.startswith(("<!", "<?"), start):
                return start, self._past(">", start), "", False, ""
            tag = _TAG.match(self.html, start)
            if tag is None:
                at = start + 1
                continue
            end = self._tag_end(tag.end())
            if end < 0:
                return None
            return start, end + 1, tag[2].lower(), bool(tag[1]), self.html[tag.end() : end]


def page_blocks(html: str) -> tuple[list[str], list[int]]:
    """The text blocks of a page in order, and the zone of each, in time linear in the page."""
    page, scanner, at, size = _Page(), _Scanner(html), 0, len(html)
    while at < size:
        found = scanner.next(at)
        if found is None:
            page.text.append(html[at:])
            break
        start, end, tag, closes, attributes = found
        page.text.append(html[at:start])
        at = end
        if not tag:
            continue
        if tag in _SPACED:
            page.text.append(" ")
        elif tag not in _INLINE:
            page.end_block()
        if closes:
            page.leave(tag)
        elif tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = scanner._past(">", close.end()) if close else size
        elif tag not in _VOID and not attributes.endswith("/"):
            if tag in {"p", "li", "option", "tr", "dt", "dd"} and page.open and page.open[-1][0] == tag:
                page.leave(tag)  # these end where the next one begins
            page.enter(tag, attributes)
    page.end_block()
    return page.blocks, page.zones
