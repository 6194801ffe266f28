"""Main-text extraction from HTML by boosted trees over nodes and a hierarchical decoding.

A page is parsed into block nodes and text segments (``htmltree``). Gradient-boosted trees give each the
probability that it holds main text, from its tag and attribute tokens, those of its ancestors, the
density of text and links in its subtree, its depth and its siblings. The decoding picks the most likely
labelling of the tree in which no node below a dropped node is kept: an ancestor's label and its
descendants' can't contradict each other. The kept segments, each with its white space made single
spaces, are joined in page order.

The trees are fitted on the driver, on ``PAGES`` pages made by a generator of page layouts (whose main text
is known), and on at most ``SAMPLE`` pages of the table that mark one article themselves and have at most
``NODES`` nodes. Executors make, parse and measure these pages; floats of their nodes come to the driver.
Extraction is one map over the rows without a shuffle; whole pages are read, in time linear in their size.

Defined results: a null or empty page, and one without text, gives an empty text. Broken and cut-off markup
is read as browsers do, roughly. Repeated rows get equal rows; other columns are ignored.
"""

from __future__ import annotations

import random
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bounded_sample, chunks
from .htmltree import Node, features, parse

#: Generated pages, and most pages of the table, that the trees are fitted on.
PAGES, SAMPLE = 900, 250
#: Most nodes of a page of the table that is fitted on; share of the nodes that a tree grows on.
NODES, DRAWN = 2000, 0.4
#: Marks main text in generated pages.
_MARK = ""


def decode(nodes: list[Node], probability: np.ndarray) -> list[bool]:
    """The most likely labels such that what is kept has kept ancestors only."""
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    best_keep, all_drop = keep[:], drop[:]
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        best_keep[up] += max(best_keep[i], all_drop[i])
        all_drop[up] += all_drop[i]
    out = [True] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = out[nodes[i].parent] and best_keep[i] > all_drop[i]
    return out


def extract(html: str | None, trees: gbt.Trees) -> list[str]:
    """The blocks of main text of a page."""
    return _extract([html], trees)[0]


def _extract(pages: list[str | None], trees: gbt.Trees) -> list[list[str]]:
    parsed = [parse(h) if h else [] for h in pages]
    rows = [features(x) for x in parsed if x]
    out: list[list[str]] = []
    x = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.float32)
    margins = trees.probability(x.reshape(sum(map(len, rows)), -1)) if rows else np.zeros(0)
    at = 0
    for nodes in parsed:
        labels = decode(nodes, margins[at : at + len(nodes)]) if nodes else []
        at += len(nodes)
        out.append([x.text for x, ok in zip(nodes, labels) if ok and x.text and not x.skip])
    return out


def _label(nodes: list[Node], leaf) -> list[int]:
    """1 for the leaves that are main text, and for all above them."""
    y = [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag == "#text":
            y[i] = int(leaf(nodes[i]))
        y[nodes[i].parent] |= y[i]
    return y


def _own_article(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that has one ``article`` (or, without, one ``main``): its text, but for parts marked as something else."""
    for tag in ("article", "main"):
        if len(found := [i for i, x in enumerate(nodes) if x.tag == tag]) == 1:
            break
    else:
        return None

    def main(leaf: Node) -> bool:
        x = leaf
        while x.parent >= 0:
            x = nodes[x.parent]
            if x is nodes[found[0]]:
                return True
            if x.tag in ("nav", "aside", "footer", "form") or x.hints & {1, 3, 4, 5, 6, 7, 8}:
                return False
        return False

    return _label(nodes, main)


def fit(pages: DataFrame, html: str = "html", key: str = "page_id") -> gbt.Trees:
    """Fit on generated pages and a bounded sample of ``pages``."""
    spark = pages.sparkSession

    def packed(nodes, labels):
        x = np.array(features(nodes), np.float32)
        return pa.RecordBatch.from_arrays([pa.array([np.array(labels, np.int8).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["y", "x"])

    def made(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                nodes = parse(_Page(random.Random(SEED + k)).html())
                labels = _label(nodes, lambda leaf: _MARK in leaf.text)
                for n in nodes:
                    n.text = n.text.replace(_MARK, "")
                yield packed(nodes, labels)

    def rows(batches):
        for b in chunks(batches, column=0):
            for page in b.column(0).to_pylist():
                nodes = parse(page or "")
                labels = _own_article(nodes) if len(nodes) <= NODES else None
                if labels:
                    # in half of the pages the marks that gave the labels are hidden from the trees
                    if len(page) % 2:
                        for n in nodes:
                            n.tag = "div" if n.tag in ("article", "main") else n.tag
                    yield packed(nodes, labels)

    sample = bounded_sample(pages.where(F.col(html).isNotNull()).select(F.col(html).alias("h"), F.col(key).alias("k"), F.lit(1).alias("one")), "k", "one", SAMPLE).select("h")
    # spread over the executors; a limit's rows are in one partition
    found = spark.range(PAGES).repartition(32).mapInArrow(made, "y binary, x binary").collect() + sample.repartition(8).mapInArrow(rows, "y binary, x binary").collect()
    found = sorted((bytes(r.y), bytes(r.x)) for r in found)
    y = np.concatenate([np.frombuffer(r[0], np.int8) for r in found]).astype(np.float64)
    x = np.concatenate([np.frombuffer(r[1], np.float32) for r in found]).reshape(len(y), -1).astype(np.float64)
    return gbt.fit(x, y, trees=50, depth=5, rate=0.2, drawn=DRAWN)


def main_text(pages: DataFrame, trees: gbt.Trees, html: str = "html", key: str = "page_id", *keep: str) -> DataFrame:
    """(key, *keep, blocks): the blocks of main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)
    kinds = dict(pages.dtypes)
    names = [key, *keep, "blocks"]

    def run(batches):
        for b in chunks(batches):
            blocks = _extract(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i + 2) for i in range(len(keep))), pa.array(blocks, pa.list_(pa.string()))], names)

    return pages.select(key, html, *keep).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names[:-1]) + ", blocks array<string>")


def report(pages: DataFrame) -> DataFrame:
    """The query's form."""
    out = main_text(pages, fit(pages), "html", "page_id", "url").withColumn("text", F.array_join("blocks", "\n\n"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# --- pages whose main text is known


#: The generated pages' seeds follow this one.
SEED = 7_000_000


def generate(n: int, seed: int = SEED):
    """``n`` pages of many layouts; main text is marked by one private character in each segment."""
    for k in range(n):
        yield _Page(random.Random(seed + k)).html()


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.plain = rng.random() < 0.3  # no telling class names
        self.semantic = rng.random() < 0.5  # elements with meanings
        self.loose = rng.random() < 0.35  # end tags left out

    def name(self, *names: str) -> str:
        if self.plain:
            return self.r.choice(["", "", f' class="{self.r.choice("abcdefgh")}{self.r.randrange(99)}"', ' class="row"', ' class="box wrap"'])
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def word(self) -> str:
        return "".join(self.r.choice("the an er on re ti es st en at to nt ha nd ou ea ng as or it is hi le é ñ ü ção".split()) for _ in range(self.r.choice([1, 1, 2, 2, 3, 4])))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize().rstrip(",") + self.r.choice([".", ".", ".", ".", "!", "?"])

    def label(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def text(self, low: int, high: int, mark: str = "") -> str:
        return mark + " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def element(self, tag: str, *names: str) -> tuple[str, str]:
        tag = tag if self.semantic or self.r.random() < 0.3 else "div"
        return f"<{tag}{self.name(*names)}>", f"</{tag}>"

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randrange(999)}">{text}</a>'

    def end(self, tag: str) -> str:
        return "" if self.loose and self.r.random() < 0.5 else f"</{tag}>"

    def main(self) -> str:
        r, m, out = self.r, _MARK, []
        if r.random() < 0.85:
            out.append(f"<h1>{m}{self.label(3, 9)}</h1>")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            k = r.random()
            if k < 0.72:
                t = self.text(1, r.choice([1, 2, 4, 9]), m) if r.random() < 0.9 else m + self.label()
                if r.random() < 0.25:
                    t = t.replace(" ", " " + self.link(self.word()) + " ", r.randint(1, 2))
                if r.random() < 0.1:
                    t = f"<b>{t}<br>" if self.loose else f"<em>{t}</em>"
                out.append(f"<p>{t}{self.end('p')}" if r.random() < 0.88 else f"<div>{t}</div>")
            elif k < 0.8:
                out.append(f"<h2>{m}{self.label(2, 7)}</h2>")
            elif k < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.text(1, 1, m)}{self.end('li')}" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.91:
                out.append(f"<blockquote><p>{self.text(1, 3, m)}</p></blockquote>")
            elif k < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.label()}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.97:
                out.append(f'<figure><img src="x.jpg"><figcaption>{self.text(1, 1, m)}</figcaption></figure>')
            else:
                out.append(self.advert())
        return "\n".join(out)

    def menu(self) -> str:
        a, b = self.element("nav", "nav", "menu", "navbar", "main-menu", "navigation", "breadcrumbs")
        links = [self.link(self.label(1, 2)) for _ in range(self.r.randint(3, 12))]
        return a + ("<ul>" + "".join(f"<li>{x}{self.end('li')}" for x in links) + "</ul>" if self.r.random() < 0.8 else " | ".join(links)) + b

    def header(self) -> str:
        a, b = self.element("header", "header", "masthead", "site-header", "topbar", "branding")
        return a + f"<div>{self.link(self.label(1, 3))}</div>" + (f"<p>{self.sentence(3, 8)}</p>" if self.r.random() < 0.6 else "") + (self.menu() if self.r.random() < 0.5 else "") + b

    def footer(self) -> str:
        a, b = self.element("footer", "footer", "site-footer", "colophon", "copyright", "bottom")
        parts = [f"&copy; {self.r.choice(['', '2021 '])}{self.word()}.example.com &middot; {self.sentence()}", f"<p>{self.text(1, 2)}</p>", self.menu(), f"<p>Copyright {self.label()}</p>"]
        return a + "".join(self.r.sample(parts, self.r.randint(1, 3))) + b

    def advert(self) -> str:
        return f"<div{self.name('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot', 'advertisement')}>{self.text(1, 2)}</div>" if not self.plain else f'<div class="ad">{self.text(1, 2)}</div>'

    def notice(self) -> str:
        return f"<div{self.name('cookie-notice', 'consent', 'notice', 'alert', 'popup', 'gdpr-banner')}>" + self.r.choice([f"<p>{self.text(1, 3)}</p>", self.text(1, 2)]) + f"<button>{self.label()}</button></div>"

    def sidebar(self) -> str:
        a, b = self.element("aside", "sidebar", "widget-area", "related", "secondary", "right-rail")
        items = [f"<div{self.name('widget', 'related-posts', 'popular')}><h3>{self.label()}</h3><ul>" + "".join(f"<li>{self.link(self.label(2, 8))}{self.end('li')}" for _ in range(self.r.randint(2, 8))) + "</ul></div>" for _ in range(self.r.randint(1, 2))]
        if self.r.random() < 0.5:
            items.append(f"<div{self.name('widget', 'about')}><h3>{self.label()}</h3><p>{self.text(1, 3)}</p></div>")
        if self.r.random() < 0.3:
            items.append(self.advert())
        return a + "".join(items) + b

    def form(self) -> str:
        return f"<form{self.name('newsletter', 'login', 'search-form', 'subscribe')}><p>{self.sentence(2, 10)}</p><label>{self.label()}</label><input name=q><button>{self.label(1, 1)}</button></form>"

    def comments(self) -> str:
        a, b = self.element("section", "comments", "comment-list", "discussion", "responses", "reader-comments")
        one = lambda: f"<b>{self.label(1, 2)}</b> <span>{self.r.randint(1, 28)}.{self.r.randint(1, 12)}.2020</span><p>{self.text(1, 4)}{self.end('p')}" + (self.link(self.label(1, 1)) if self.r.random() < 0.5 else "")
        body = [f"<li{self.name('comment', 'comment-body')}>{one()}{self.end('li')}" if self.r.random() < 0.5 else f"<div{self.name('comment', 'reply')}>{one()}</div>" for _ in range(self.r.randint(1, 6))]
        return a + f"<h3>{self.label(1, 3)}</h3>" + "".join(body) + (self.form() if self.r.random() < 0.4 else "") + b

    def html(self) -> str:
        r = self.r
        a, b = self.element(r.choice(["article", "main", "article", "section"]), "content", "post", "entry-content", "article-body", "story", "main-content", "post-body")
        article = a + self.main() + b
        after = [f() for f, k in ((self.comments, 0.35), (self.form, 0.15), (self.advert, 0.3)) if r.random() < k]
        before = [f() for f, k in ((self.header, 0.6), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.4)) if r.random() < k]
        side = [self.sidebar()] if r.random() < 0.45 else []
        if r.random() < 0.2:  # comments or adverts inside of the article's own element
            article, after = a + self.main() + "".join(after) + b, []
        middle = [*side, article] if r.random() < 0.3 else [article, *side]
        for _ in range(r.choice([0, 0, 1, 2])):
            middle = [f"<div{self.name('container', 'wrapper', 'page', 'row', 'layout')}>", *middle, "</div>"]
        r.shuffle(before)
        parts = [*before, *middle, *after, *([self.footer()] if r.random() < 0.85 else [])]
        page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.label(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' + r.choice(["", "\n"]).join(parts) + "</body></html>"
        return page if r.random() < 0.9 else page[: int(len(page) * r.uniform(0.6, 0.99))]
