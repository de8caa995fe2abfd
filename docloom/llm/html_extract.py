"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded from the root down.

The trees give each node the probability that its subtree holds main text. Decoding then takes the
likeliest labelling in which every kept node has a kept parent and every dropped node has only
dropped descendants, so an ancestor and a descendant never contradict each other.

There are no labelled pages, so the trees are fitted on pages that `training_page` composes: site
furniture of many kinds around articles, from the same invented sentences, told apart by markup alone.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import decoded, map_rows, quoted, ready, small_batches, without
from .dom import Node, describe, parse, text_of

# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Complete binary trees of one depth: node k of a level splits into 2k and 2k + 1."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = at + (1 << level) - 1
                at = 2 * at + (x[rows, feature[k]] > threshold[k])
            total += value[at]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 90, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, share: float = 0.4, seed: int = 5) -> Trees:
    """Logistic gradient boosting with histograms of second-order sums; each tree sees a random share of the rows."""
    n, width = x.shape
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    flat = (binned + np.arange(width) * bins).astype(np.int64)
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        drawn = np.flatnonzero(rng.random(n) < share) if share < 1 else np.arange(n)
        g, h = ((p - y) * weight)[drawn], (np.maximum(p * (1 - p), 1e-6) * weight)[drawn]
        own, own_flat = x[drawn], flat[drawn]
        feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf, np.float32)
        at = np.zeros(len(drawn), np.int64)
        for level in range(depth):
            size = width * bins
            key = (at[:, None] * size + own_flat).ravel()
            shape = (1 << level, width, bins)
            sum_g = np.bincount(key, np.repeat(g, width), (1 << level) * size).reshape(shape)
            sum_h = np.bincount(key, np.repeat(h, width), (1 << level) * size).reshape(shape)
            left_g, left_h = sum_g.cumsum(2)[:, :, :-1], sum_h.cumsum(2)[:, :, :-1]
            all_g, all_h = sum_g.sum(2)[:, :1, None], sum_h.sum(2)[:, :1, None]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            best = gain.reshape(1 << level, -1).argmax(1)
            for node in range(1 << level):
                j, b = divmod(int(best[node]), bins - 1)
                if gain[node, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[(1 << level) - 1 + node], threshold[(1 << level) - 1 + node] = j, cuts[j][b]
            k = at + (1 << level) - 1
            at = 2 * at + (own[np.arange(len(drawn)), feature[k]] > threshold[k])
        value = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
        margin += Trees(np.array([feature]), np.array([threshold]), np.array([value]), 0.0, depth).margin(x)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base, depth)


def decode(nodes: list[Node], probability: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labelling in which kept nodes have kept parents."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        keep[up] += max(keep[i], drop[i])
        drop[up] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


# ---------------------------------------------------------------- training pages

_SYLLABLES = "ba be bi co cu da de di fa fe ga go ha hi ja ka ke la li lo ma me mi na ne no pa pe po ra re ri sa se so ta te ti un ur va vi wa wi ya zo".split()
#: Words that sites give to classes and ids, by what they mark.
NAMES = {
    "article": "article content post entry story main body text post-body article-body entry-content story-body main-content page-content post-content blog-post news-article prose".split(),
    "nav": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs site-nav nav-links pagination pager tabs toc-nav".split(),
    "header": "header masthead top site-header page-header topbar branding logo banner-top hd".split(),
    "footer": "footer bottom site-footer copyright colophon legal foot page-footer imprint ft".split(),
    "side": "sidebar side aside rail widget widgets secondary related recent popular recommended more-stories right-col left-col trending tags".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot adsbox banner-ad ad-container commercial dfp teaser-ad native-ad".split(),
    "notice": "cookie cookies notice consent gdpr cookie-banner alert popup modal overlay subscribe newsletter paywall message disclaimer warning privacy-banner signup".split(),
    "comments": "comments comment comment-list discussion responses replies reply disqus reader-comments comment-thread user-comments feedback".split(),
    "form": "form search search-form login contact-form newsletter-form subscribe-form field".split(),
    "share": "share social sharing share-buttons toolbar tools follow print social-links".split(),
}
_PLAIN = "row col wrap inner box container grid section block unit panel c1 l-main u-mt js-x span12 clearfix group left right".split()


class _Page:
    """Composes one page; text inside the marks \\x01 and \\x02 is main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.mute = self.r.random() < 0.12  # this site's names tell nothing
        self.semantic = self.r.random() < 0.6

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return out[:1].upper() + out[1:]

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 14) + self.r.choice("..?!") for _ in range(self.r.randint(low, high)))

    def attrs(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = self.word() if self.mute else r.choice(NAMES[kind])
        if r.random() < 0.3:
            name += " " + r.choice(_PLAIN)
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def wrap(self, kind: str, tags: list[str], inner: str) -> str:
        semantic = [t for t in tags if t not in ("div", "section")]
        tag = self.r.choice(semantic if semantic and self.semantic else tags)
        plain = tag in semantic and self.r.random() < 0.5
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            inner = f"<div{f' class={chr(34)}{self.r.choice(_PLAIN)}{chr(34)}' if self.r.random() < 0.6 else ''}>{inner}</div>"
        return f"<{tag}{'' if plain else self.attrs(kind)}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        kind = r.choice(["ul", "ul", "ol", "div", "p"])
        items = [f'<a href="/{self.word()}">{self.words(1, r.choice([1, 2, 6]))}</a>' for _ in range(r.randint(low, high))]
        return f"<{kind}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{kind}>" if kind in ("ul", "ol") else f"<{kind}>" + r.choice([" ", " | ", ""]).join(items) + f"</{kind}>"

    def loose(self, low: int, high: int) -> str:
        text = self.sentences(low, high)
        return self.r.choice([f"<p>{text}</p>", text, f"<span>{text}</span>", f"<div>{text}</div>"])

    def furniture(self, kind: str) -> str:
        r, w = self.r, self.wrap
        if kind == "nav":
            return w("nav", ["nav", "div", "ul"], self.links(2, 12))
        if kind == "header":
            name = f"<h1>{self.words(1, 4)}</h1>" if self.semantic and r.random() < 0.3 else r.choice([f'<a href="/">{self.words(1, 3)}</a>', ""])
            return w("header", ["header", "div"], name + self.loose(1, 2) + r.choice(["", self.furniture("nav")]))
        if kind == "footer":
            mark = r.choice(["&copy; ", "&#169; 2020 ", ""])
            return w("footer", ["footer", "div"], r.choice([f"{mark}{self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{mark}{self.sentences(1, 3)}</p>" + self.links(1, 6), self.links(3, 12) + f"<p>{mark}{self.words(1, 6)}</p>"]))
        if kind == "side":
            return w("side", ["aside", "div", "section"], f"<h3>{self.words(1, 4)}</h3>" + r.choice([self.links(2, 9), self.loose(1, 3) + self.links(1, 5), self.loose(1, 4)]))
        if kind == "ad":
            return w("ad", ["div", "aside", "section", "div"], r.choice([self.sentences(1, 3), self.loose(1, 3), f'<a href="http://x.example/{self.word()}">{self.sentences(1, 2)}</a>', self.words(2, 6) + ".\n" + self.sentences(1, 1)]))
        if kind == "notice":
            return w("notice", ["div", "section", "div"], self.loose(1, 4) + r.choice(["", f"<button>{self.words(1, 2)}</button>", f'<a href="#">{self.words(1, 2)}</a>']))
        if kind == "form":
            return f"<form{self.attrs('form')}>" + r.choice(["", f"<p>{self.sentences(1, 2)}</p>"]) + f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button></form>"
        if kind == "share":
            return w("share", ["div", "ul"], self.links(2, 6))
        each = "".join(w("comments", ["div", "li", "article"] if r.random() < 0.3 else ["div", "li"], r.choice([f"<b>{self.word()}</b> ", f"<h4>{self.word()}</h4>", ""]) + f"<p>{self.sentences(1, 5)}</p>") for _ in range(r.randint(1, 6)))
        return w("comments", ["section", "div", "div"], r.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + each)

    def paragraph(self) -> str:
        r = self.r
        text = self.sentences(1, r.choice([1, 3, 8])) if r.random() < 0.9 else self.words(1, 2) + "."
        if r.random() < 0.2:
            text += f' <a href="/{self.word()}">{self.words(1, 4)}</a> {self.words(2, 8)}.'
        if r.random() < 0.15:
            text = f"<em>{self.words(1, 3)}</em> {text}"
        kind = r.random()
        if kind < 0.68:
            return f"<p>\x01{text}\x02</p>"
        if kind < 0.78:
            return f"<p><b>\x01{text}\x02<br>"
        if kind < 0.86:
            return f"<div>\x01{text}\x02</div>"
        if kind < 0.92:
            return f"<h{r.randint(2, 4)}>\x01{self.words(1, 8)}\x02</h2>"
        if kind < 0.96:
            return "<ul>" + "".join(f"<li>\x01{self.words(2, 12)}\x02</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        return f"<blockquote>\x01{text}\x02</blockquote>"

    def article(self) -> str:
        r = self.r
        parts = [self.paragraph() for _ in range(r.choice([0, 1, 2, 4, 8, 14, 24]))] or [f"<p>\x01{self.words(1, 9)}.\x02</p>"]
        for kind in ("ad", "share", "notice", "form", "side", "comments", "nav"):
            if r.random() < 0.12:
                parts.insert(len(parts) if kind == "comments" else r.randint(0, len(parts)), self.furniture(kind))
        title = f"<h1>\x01{self.words(2, 12) if r.random() < 0.6 else self.sentences(1, 3)}\x02</h1>"
        if r.random() < 0.9:
            parts.insert(0, title if r.random() < 0.8 else f"<header>{title}</header>")
        inner = "".join(parts)
        if r.random() < 0.3:
            inner = f"<div{self.attrs('article')}>{inner}</div>"
        return self.wrap("article", ["article", "main", "div", "section", "article"], inner)

    def build(self) -> str:
        r = self.r
        head = f"<head><meta charset=utf-8><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
        before = [k for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < (0.6 if k == "nav" else 0.3)]
        after = [k for k in ("share", "ad", "side", "comments", "form", "nav", "notice") if r.random() < 0.25]
        if r.random() < 0.75:
            after.append("footer")
        inner = "".join([*map(self.furniture, before), self.article(), *map(self.furniture, after)])
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = f'<div id="{r.choice(["page", "wrapper", "root", "site", "app", "container", self.word()])}">{inner}</div>'
        return f"<!DOCTYPE html><html lang=en>{head}<body>{inner}</body></html>"


def training_page(seed: int) -> tuple[str, str]:
    """(html, its main text) of an invented page."""
    marked = _Page(seed).build()
    nodes = parse(marked)
    clean = [" ".join(n.text.replace("\x01", "").replace("\x02", "").split()) for n in nodes if n.tag == "#text" and "\x01" in n.text]
    return marked.replace("\x01", "").replace("\x02", ""), "\n".join(clean)


@dataclass
class Extractor:
    odds: dict[str, float]
    trees: Trees

    def kept(self, pages: list[list[Node]]) -> list[np.ndarray]:
        rows = [describe(nodes, self.odds) for nodes in pages]
        p = 1 / (1 + np.exp(-np.clip(self.trees.margin(np.concatenate(rows)), -30, 30)))
        edges = np.cumsum([len(r) for r in rows])[:-1]
        return [decode(nodes, part) for nodes, part in zip(pages, np.split(p, edges), strict=True)]

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s or "") for s in sources]
        return [text_of(nodes, kept) for nodes, kept in zip(pages, self.kept(pages), strict=True)] if pages else []


def train(pages: int = 1500, seed: int = 20240301) -> Extractor:
    """Fit on `pages` invented pages; the same extractor for the same arguments."""
    marked = [parse(_Page(seed + i).build()) for i in range(pages)]
    labels = []
    for nodes in marked:
        main = np.array(["\x01" in n.text for n in nodes])
        for n in nodes:
            n.text = ""
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] |= main[i]
        labels.append(main)
    good, bad = Counter(), Counter()
    for nodes, main in zip(marked[::2], labels[::2], strict=True):
        for n, y in zip(nodes, main, strict=True):
            (good if y else bad).update({*n.tokens, "<" + n.tag})
    all_good, all_bad = sum(good.values()), sum(bad.values())
    odds = {t: float(np.log((good[t] + 1) / (all_good + 1)) - np.log((bad[t] + 1) / (all_bad + 1))) for t in good | bad if good[t] + bad[t] >= 3}
    x, y = np.concatenate([describe(n, odds) for n in marked]), np.concatenate(labels).astype(float)
    return Extractor(odds, boost(x, y, np.ones(len(y))))


def extract(pages: DataFrame, extractor: Extractor | None = None, html: str = "html") -> DataFrame:
    """pages with two more columns: text, the main text of `html`, and n_chars, its code points.

    Null and empty html give ''; what is not UTF-8 is read as replacement characters (U+FFFD). All rows and other columns stay, repeated pages too, and an empty
    table gives no rows; columns named text and n_chars, in any case, are replaced. Pages are never
    shuffled; a task holds a small batch of pages, or one long page.
    """
    spark = pages.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(extractor or train())
    others = without(pages, "text", "n_chars")
    kept = pages.select(*(quoted(c) for c in others))
    schema = kept.schema.add("text", "string").add("n_chars", "long")
    source = pages.select(*(quoted(c) for c in others), quoted(html).cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, len(others), 2 << 20):
            texts = shared.value.texts([decoded(h) for h in batch.column(batch.num_columns - 1).to_pylist()])
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), lengths], schema.names)

    return map_rows(source, run, schema)
