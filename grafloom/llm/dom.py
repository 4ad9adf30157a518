"""Pages as trees of block elements and text blocks, and features of their nodes, for many pages at once.

Tags are read as HTML's tokenizer reads them: quoted attribute values, comments, elements whose content is no text, and
end tags that may be left out.  What stands between two block boundaries is one block: character references decoded, runs
of white space one blank, none at the ends.  Inline elements and comments bound no block; a line break counts as white
space.  An unfinished tag, comment or script takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np

#: Elements that bound blocks, that have no content, and whose content is no text of the page.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title textarea template iframe noembed noframes noscript xmp svg math object".split())
#: A start tag on the left ends these open elements, up to those on the right.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "optgroup": (("optgroup", "option"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "body": (("head",), ("body",)),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPE = frozenset(("table", "td", "th", "caption", "html"))
TABLE = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"))

#: Kinds of nodes that features tell apart; a text block has the last.
KINDS = ("html", "head", "body", "article", "main", "section", "div", "p", "h1", "h2", "list", "li", "nav", "aside", "header", "footer", "form", "table", "cell", "quote", "figure", "control", "other", "text")
_KIND_OF = {
    **{k: k for k in KINDS[:17]}, **dict.fromkeys(HEADINGS[1:], "h2"), **dict.fromkeys(("ul", "ol", "dl", "menu", "dir"), "list"), **dict.fromkeys(("li", "dt", "dd"), "li"), **dict.fromkeys(("fieldset", "legend", "search"), "form"),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr"), "table"), **dict.fromkeys(("td", "th", "caption"), "cell"), **dict.fromkeys(("blockquote", "pre"), "quote"), **dict.fromkeys(("figure", "figcaption"), "figure"), **dict.fromkeys(("button", "select", "option", "optgroup"), "control"),
}
KIND = {tag: KINDS.index(_KIND_OF.get(tag, "other")) for tag in BLOCKS}
TEXT = len(KINDS) - 1
#: Attributes whose words tell what an element is for.
TOLD = frozenset(("class", "id", "role", "itemprop"))

_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_SKIP = re.compile(r"[\t\n\f\r /]*")
_KEY = re.compile(r"=?[^\t\n\f\r />=]*")
_IS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def words_of(value: str) -> list[str]:
    """The words of a name, by hyphens, digits and capitals, in their first five letters."""
    return [w.lower()[:5] for w in _WORD.findall(value)]


class Forest:
    """Nodes of pages in the order of their start; a node's subtree is what stands before its ``end``."""

    def __init__(self):
        self.parent: list[int] = []
        self.kind: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.page: list[int] = []
        self.text: dict[int, str] = {}
        self.link: dict[int, int] = {}
        self.names: list[tuple[int, str]] = []
        self.roots: list[int] = []

    def add(self, page: str) -> None:
        """Reads one page."""
        self.roots.append(len(self.parent))
        reader = _Reader(self, page)
        reader.read()

    def node(self, kind: int, parent: int, depth: int) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.kind.append(kind)
        self.depth.append(depth)
        self.end.append(at + 1)
        self.page.append(len(self.roots) - 1)
        return at


class _Reader:
    def __init__(self, forest: Forest, page: str):
        self.f, self.page = forest, page
        self.stack: list[tuple[str, int]] = [("", forest.node(KINDS.index("other"), -1, 0))]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked, self.link_from = 0, 0  # characters of links in the block; where the open link stands, or 0

    def read(self) -> None:
        page, n, pos = self.page, len(self.page), 0
        while pos < n:
            lt = page.find("<", pos)
            if lt < 0:
                self.say(page[pos:])
                break
            if lt > pos:
                self.say(page[pos:lt])
            c = page[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                end = page.find("-->", lt + 2) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
                pos = n if end < lt else end + 1
            elif c == "/":
                m = _NAME.match(page, lt + 2)
                if m:
                    pos = self.attributes(m.end(), None)
                    if pos <= n:
                        self.close(m[0].lower())
                else:
                    end = page.find(">", lt)
                    pos = n if end < 0 else end + 1
            elif c.isascii() and c.isalpha():
                m = _NAME.match(page, lt + 1)
                tag = m[0].lower()
                names: list[str] | None = [] if tag in BLOCKS else None
                pos = m.end() + 1 if page.startswith(">", m.end()) else self.attributes(m.end(), names)
                if pos > n:
                    break
                if tag in SILENT:
                    end = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(page, pos)
                    pos = self.attributes(end.end(), None) if end else n
                else:
                    self.start(tag, names)
            else:
                self.say("<")
                pos = lt + 1
        self.flush()
        self.pop(0)

    def attributes(self, pos: int, names: list[str] | None) -> int:
        """The place behind the tag, beyond the page if it has no end; words of telling attributes go to ``names``."""
        page, n = self.page, len(self.page)
        while True:
            pos = _SKIP.match(page, pos).end()
            if pos >= n:
                return n + 1
            if page[pos] == ">":
                return pos + 1
            key = _KEY.match(page, pos)
            pos, value = key.end(), ""
            if is_ := _IS.match(page, pos):
                pos = is_.end()
                if page[pos : pos + 1] in ('"', "'") and pos < n:
                    end = page.find(page[pos], pos + 1)
                    if end < 0:
                        return n + 1
                    value, pos = page[pos + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, pos)
                    value, pos = bare[0], bare.end()
            if names is not None and key[0].lower() in TOLD:
                names.extend(words_of(value))

    def say(self, text: str) -> None:
        if "&" in text:
            text = _html.unescape(text)
        self.parts.append(text)
        if self.link_from:
            self.linked += len(text.strip())

    def flush(self) -> None:
        """Ends the block that is open."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                at = self.f.node(TEXT, self.stack[-1][1], len(self.stack))
                self.f.text[at] = text
                self.f.link[at] = min(self.linked, len(text))
            self.parts.clear()
        self.linked = 0

    def start(self, tag: str, names: list[str] | None) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag == "hr":
            self.flush()
        elif tag == "a":
            self.link_from = len(self.stack)
        if tag not in BLOCKS or tag in ("html", "body", "head") and self.open.get(tag):
            return
        self.flush()
        if self.open.get("p"):
            self.end("p", (*SCOPE, "button"))
        if tag in IMPLIED:
            gone, bounds = IMPLIED[tag]
            for x in gone:
                if self.open.get(x):
                    self.end(x, bounds)
        elif tag in HEADINGS and self.stack[-1][0] in HEADINGS or tag != "head" and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)
        at = self.f.node(KIND[tag], self.stack[-1][1], len(self.stack))
        self.f.names.extend((at, w) for w in names or ())
        self.stack.append((tag, at))
        self.open[tag] = self.open.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link_from = 0
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "p":
            self.flush()
        if tag in BLOCKS and tag not in ("html", "body") and self.open.get(tag):
            self.end(tag, () if tag in TABLE else SCOPE)

    def end(self, tag: str, bounds) -> None:
        """Ends the innermost element of this tag, if none of ``bounds`` lies above it."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.flush()
                self.pop(k)
                return
            if self.stack[k][0] in bounds:
                return

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, at = self.stack.pop()
            self.f.end[at] = len(self.f.parent)
            if tag:
                self.open[tag] -= 1
        if self.link_from > to:
            self.link_from = 0


#: What a node is inside of; names of the features of ``numbers``.
INSIDE = ("article", "main", "nav", "aside", "header", "footer", "form", "li", "table", "quote")
_STOPS = re.compile(r"[.!?;:。！？]")


def numbers(f: Forest) -> np.ndarray:
    """(node, feature): kinds, places, sizes and densities of subtrees, and what stands beside."""
    n = len(f.parent)
    parent, kind, depth, end, page = (np.array(x, np.int64) for x in (f.parent, f.kind, f.depth, f.end, f.page))
    at, up = np.arange(n), np.maximum(parent, 0)
    own = np.zeros((5, n))  # characters, of links, words, stops, blocks
    for k, text in f.text.items():
        own[:, k] = len(text), f.link[k], text.count(" ") + 1, len(_STOPS.findall(text)), 1
    before = np.concatenate([np.zeros((5, 1)), np.cumsum(own, axis=1)], axis=1)
    chars, links, words, stops, blocks = before[:, end] - before[:, :-1]
    root = np.array(f.roots)[page] if n else at
    whole = np.maximum(chars[root], 1)
    size = np.maximum(chars, 1)
    # Siblings: the node that starts where the one before ends, if it has the same parent.
    after = np.where((end < n) & (parent[np.minimum(end, n - 1)] == parent), np.minimum(end, n - 1), -1) if n else at
    prior = np.full(n, -1)
    prior[after[after >= 0]] = at[after >= 0]
    many = np.bincount(up[parent >= 0], minlength=n)
    place = np.zeros(n)
    for k in np.flatnonzero(prior >= 0).tolist():
        place[k] = place[prior[k]] + 1
    _, which, often = np.unique((parent + 1) * len(KINDS) + kind, return_inverse=True, return_counts=True)
    beside = lambda x, who: np.where(who >= 0, x[np.maximum(who, 0)], -1.0)
    density, log = links / size, np.log1p(chars)
    columns = [kind == k for k in range(len(KINDS))] + [np.where(parent >= 0, kind[up], -1) == k for k in range(TEXT)]
    for name in INSIDE:
        change = np.zeros(n + 1, np.int64)
        marked = np.flatnonzero(kind == KINDS.index(name))
        np.add.at(change, marked, 1)
        np.add.at(change, end[marked], -1)
        columns.append(np.cumsum(change[:-1]) > 0)
    siblings = np.maximum(many[up], 1)
    columns += [
        depth, log, chars / whole, density, words / np.maximum(blocks, 1), stops / np.maximum(words, 1), np.log1p(blocks), np.log1p(chars / np.maximum(blocks, 1)), before[0, :-1] / whole - before[0, root] / whole,
        place / siblings, np.log1p(siblings), np.where(parent >= 0, often[which], 1) / siblings, beside(log, prior), beside(density, prior), beside(log, after), beside(density, after), beside(kind, prior) == kind, log[up], density[up], chars / np.maximum(chars[up], 1), np.log1p(many),
    ]
    return np.array(columns, np.float32).T


def named(f: Forest, odds: dict[str, float]) -> np.ndarray:
    """(node, feature): the least and the greatest odds of the words of its own attributes (a text's: its element's), and
    of those and all around it; words without odds count as 0."""
    n = len(f.parent)
    own = np.zeros((2, n))
    for k, name in f.names:
        x = odds.get(name, 0.0)
        own[0, k], own[1, k] = min(own[0, k], x), max(own[1, k], x)
    text = np.array(f.kind) == TEXT
    own[:, text] = own[:, np.array(f.parent, np.int64)[text]]
    least, most = own.tolist()
    for k, p in enumerate(f.parent):
        if p >= 0:
            least[k], most[k] = min(least[k], least[p]), max(most[k], most[p])
    return np.concatenate([own, [least, most]]).T.astype(np.float32)
