"""A forgiving HTML parser for text extraction: blocks, text segments and their features.

The time is linear in the page: where an element is closed is looked up in lists of the open elements' places
by tag, never searched for, and each element is closed once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SKIP = frozenset("script style template noscript iframe object svg math canvas title select option button textarea datalist audio video map head".split()) - {"head"}
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening tag ends an open element of these, up to the nearest element of the second group.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

#: An end tag of another kind doesn't close what is outside of the innermost of these; those of the second kind do.
WALLS, OVER_WALLS = frozenset(("td", "th", "table")), frozenset(("table", "tr", "tbody", "body", "html"))
_ENDING = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.I) for tag in RAW}

GROUPS = ["html body", "article main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu dir", "nav", "header hgroup", "footer address", "aside", "form fieldset", "table tbody thead tfoot tr td th caption", "figure figcaption", "blockquote pre details summary", "#text"]
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags.split()}
#: Words in classes, ids and roles, by what they tell.
HINTS = [
    "article content post entry body main story text hentry paragraph prose maincontent articlebody postcontent contentbody",
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip menubar",
    "header masthead head branding logo topbar site tagline banner",
    "footer foot copyright legal colophon contentinfo bottom",
    "sidebar aside widget related rail complementary secondary recommended popular trending more teaser tags meta",
    "cookie cookies notice consent gdpr alert popup modal overlay dialog privacy warning toast message announcement",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp adsense banner commercial",
    "comment comments reply replies respond discussion disqus responses commentlist reader",
    "form login signup subscribe newsletter search share social follow register signin contact email",
]
_HINT: dict[str, set[int]] = {}
for _i, _words in enumerate(HINTS):
    for _w in _words.split():
        _HINT.setdefault(_w, set()).add(_i)


class Node:
    __slots__ = ("tag", "parent", "depth", "hints", "above", "skip", "index", "text", "linked", "chars", "words", "links", "marks", "tags", "leaves", "headings", "first", "children", "hidden", "stops", "tokens")

    def __init__(self, tag: str, parent: int, depth: int, skip: bool):
        self.tag, self.parent, self.depth, self.skip = tag, parent, depth, skip
        self.hints, self.above, self.text, self.children, self.tokens = set(), set(), "", [], []
        self.linked = self.chars = self.words = self.links = self.marks = self.tags = self.leaves = self.headings = self.index = self.first = self.stops = 0
        self.hidden = False


class _Open:
    """The open elements, with the places of each tag, of blocks, and of what end tags don't reach across."""

    def __init__(self):
        self.tags, self.nodes = ["html"], [0]  # each with its block node
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: list[int] = []

    def push(self, tag: str, node: int) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.nodes.append(node)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in WALLS:
            self.walls.append(at)

    def pop(self) -> str:
        tag = self.tags.pop()
        self.nodes.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        if tag in WALLS:
            self.walls.pop()
        return tag

    def last(self, *tags: str) -> int:
        """The place of the innermost of these, 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def parse(html: str) -> list[Node]:
    """Block nodes and, as leaves with tag ``#text``, text segments, in page order; parents come first."""
    nodes = [Node("html", -1, 0, False)]
    open_ = _Open()
    buffer: list[str] = []
    linked, pos, n = 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            at = open_.nodes[-1]
            if text and not nodes[at].skip:
                leaf = Node("#text", at, nodes[at].depth + 1, False)
                leaf.text, leaf.linked = text, min(linked, len(text))
                nodes[at].children.append(len(nodes))
                nodes.append(leaf)
            buffer.clear()
        linked = 0

    def close(to: int) -> None:
        while len(open_.tags) > max(1, to):
            if open_.tags[-1] in BLOCK or open_.tags[-1] in SKIP:
                flush()
            open_.pop()

    while pos < n:
        m = _TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos and not nodes[open_.nodes[-1]].skip:
            # a reference ends where a tag begins
            piece = unescape(html[pos:end])
            buffer.append(piece)
            if open_.places.get("a"):
                linked += len(piece.strip())
        if not m:
            break
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag == "br":
                buffer.append(" ")
            at = open_.last(tag)
            if at and (tag in OVER_WALLS or not open_.walls or open_.walls[-1] <= at):
                close(at)
            if tag in BLOCK:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            buffer.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK or tag in SKIP:
            if tag in BLOCK:
                if open_.blocks and open_.tags[open_.blocks[-1]] == "p":
                    close(open_.blocks[-1])
                if tag in ENDS:
                    ends, until = ENDS[tag]
                    at = open_.last(*ends)
                    if at > open_.last(*until):
                        close(at)
            flush()
            if tag in ("html", "body") and len(open_.tags) > 1:
                continue
            if tag in VOID:
                continue
            parent = open_.nodes[-1]
            node = Node(tag, parent, nodes[parent].depth + 1, nodes[parent].skip or tag in SKIP)
            if attrs and not node.skip:
                for key, a, b, c in _ATTR.findall(attrs):
                    key = key.lower()
                    if key in ("class", "id", "role", "itemprop", "data-component", "aria-label"):
                        found = _TOKEN.findall(_CAMEL.sub(" ", a or b or c).lower())
                        node.tokens += found
                        for w in found:
                            node.hints |= _HINT.get(w, set())
                    elif key in ("hidden",) or key == "style" and "display:none" in (a or b or c).replace(" ", "").lower() or key == "aria-hidden" and (a or b or c) == "true":
                        node.hidden = True
            nodes[parent].children.append(len(nodes))
            nodes.append(node)
            open_.push(tag, len(nodes) - 1)
            if tag in RAW:
                ending = _ENDING[tag].search(html, pos)
                pos = ending.end() if ending else n
                open_.pop()
        elif tag not in VOID:
            open_.push(tag, open_.nodes[-1])
            nodes[open_.nodes[-1]].links += tag == "a"
    flush()
    return nodes


def features(nodes: list[Node]) -> list[list[float]]:
    """Dense features of each node: markup, ancestors, subtree densities, siblings and place."""
    before = 0
    for i, x in enumerate(nodes):
        up = nodes[x.parent] if i else None
        if up is not None:
            x.above = up.above | up.hints | {20 + _GROUP.get(up.tag, 3)}
            x.hidden |= up.hidden
        x.first = before
        if x.tag == "#text":
            x.chars, x.words, x.leaves = len(x.text), x.text.count(" ") + 1, 1
            x.marks = sum(map(x.text.count, ",;:"))
            x.stops = sum(map(x.text.count, ".!?"))
            before += x.chars
    total = max(1, before)
    for i in range(len(nodes) - 1, 0, -1):
        x, up = nodes[i], nodes[nodes[i].parent]
        up.chars += x.chars
        up.words += x.words
        up.linked += x.linked
        up.links += x.links
        up.marks += x.marks
        up.stops += x.stops
        up.leaves += x.leaves
        up.tags += x.tags + (x.tag != "#text")
        up.headings += x.headings + (x.tag in ("h1", "h2", "h3"))
    for x in nodes:
        for k, c in enumerate(x.children):
            nodes[c].index = k
    alike = [Counter(nodes[c].tag for c in x.children) if x.children else {} for x in nodes]
    out = []
    for i, x in enumerate(nodes):
        up = nodes[x.parent] if i else x
        sib = up.children if i else [0]
        prev = nodes[sib[x.index - 1]].chars if x.index else 0
        later = nodes[sib[x.index + 1]].chars if x.index + 1 < len(sib) else 0
        same = alike[x.parent][x.tag] if i else 1
        chars, words = max(1, x.chars), max(1, x.words)
        kind, above = _GROUP.get(x.tag, 3), x.above
        parent_kind = _GROUP.get(up.tag, 3)
        row = [
            kind, parent_kind, x.depth, x.index, len(sib), same / max(1, len(sib)), len(x.children), x.hidden,
            math.log1p(x.chars), math.log1p(x.words), x.linked / chars, x.links / words, x.marks / words, x.stops / words, words / max(1, x.stops), x.chars / (1 + x.tags), math.log1p(x.tags), x.leaves, x.chars / max(1, x.leaves), x.headings,
            x.first / total, x.chars / total, (x.first + x.chars) / total, math.log1p(prev), math.log1p(later), math.log1p(up.chars), x.chars / max(1, up.chars), up.linked / max(1, up.chars), up.chars / max(1, up.leaves),
            "\xa9" in x.text or "copyright" in x.text.lower(), x.text[-1:] in ".!?\"'”…", x.text[:1].isupper(),
        ]
        row += [h in x.hints for h in range(len(HINTS))]
        row += [h in above for h in range(len(HINTS))]
        row += [20 + g in above for g in (1, 4, 7, 8, 9, 10, 11, 12, 13, 14, 16)]
        out.append(row)
    return out
