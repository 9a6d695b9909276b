"""Main text of web pages: a bidirectional LSTM labels every block of a page by its tag path, its words and its neighbours."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import read

PATH_BUCKETS = 1024
WORD_BUCKETS = 1024
EMBEDDING = 16
HIDDEN = 16
SHAPE = 9
#: Generated pages that the labeller is trained on, and how often.
TRAIN_PAGES = 900
EPOCHS = 8
RATE = 0.03
#: Pages labelled side by side.
PAGES = 64

_MATH = "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded semantics"
INLINE = frozenset(f"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr {_MATH}".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN_TAGS = frozenset("script style noscript template textarea select title svg iframe object audio video canvas head annotation annotation-xml".split())
#: What an opening tag ends when it is still open, up to the given parents.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[\"'>]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_UPPERS = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0400-\u042f]+")
_NUMBERS = re.compile("[0-9]+")
#: Names at the end of a path that also count by themselves.
NEAR_NAMES = 4


@dataclass
class Block:
    """A run of text between the borders of block elements. path: hash buckets of the names of the elements around it."""

    path: list[int]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's features: its tag and the parts of its class, id and role."""
    out = [tag]
    if attributes:
        for m in _NAMES.finditer(attributes):
            for part in _PART.findall(m[1] or m[2] or m[3] or ""):
                out.append("." + part.lower())
    return tuple(out)


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """start, end, closing, name and attributes of each tag, in order; comments and declarations have an empty name.

    A tag ends at the first > outside quotes or, if a quote is never closed, at the first > at all. A < without any > after
    it is text. Whoever gets a tag may send a place to go on from. The work is linear in the page: every quote from which
    no end can be reached is remembered.
    """
    at, last, lost = 0, page.rfind(">"), set()
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            moved = yield at, end if end > 2 else len(page), False, "", ""
            at = moved or (end if end > 2 else len(page))
            continue
        if at > last:
            return
        if after and after in "!?":
            end = page.find(">", at) + 1
            moved = yield at, end, False, "", ""
            at = moved or end
            continue
        closing = after == "/"
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            at += 1
            continue
        place, passed = name.end(), []
        while True:
            m = _QUOTE_OR_END.search(page, place)
            if m is not None and m[0] == ">":
                end = m.end()
                break
            closed = -1
            if m is not None and m.start() not in lost:
                passed.append(m.start())
                closed = page.find(m[0], m.end())
            if closed < 0:
                lost.update(passed)
                end = page.find(">", name.end()) + 1
                break
            place = closed + 1
        moved = yield at, end, closing, name[0].lower(), page[name.end() : end - 1]
        at = moved or end


class _Open:
    """The open elements, with the places of each tag and how often each path bucket is there."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...], tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.buckets: dict[int, int] = {}

    def push(self, tag: str, attributes: str) -> None:
        names = names_of(tag, attributes)
        ids = tuple(zlib.crc32(n.encode()) % PATH_BUCKETS for n in names)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, names, ids))
        for b in ids:
            self.buckets[b] = self.buckets.get(b, 0) + 1

    def cut(self, place: int) -> None:
        for tag, _, ids in self.stack[place:]:
            self.places[tag].pop()
            for b in ids:
                if self.buckets[b] == 1:
                    del self.buckets[b]
                else:
                    self.buckets[b] -= 1
        del self.stack[place:]

    def innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def path(self) -> list[int]:
        near: list[str] = []
        for _, names, _ in reversed(self.stack):
            near[:0] = names
            if len(near) >= NEAR_NAMES:
                break
        return [*self.buckets, *(zlib.crc32(b"^" + n.encode()) % PATH_BUCKETS for n in near[-NEAR_NAMES:])]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order, in time linear in the page's length, however broken it is.

    Character references are decoded and white space is one space; comments, scripts, styles and the like are gone.
    """
    out: list[Block] = []
    opened = _Open()
    links, at, block = 0, 0, None

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            if piece.isspace():
                return
            block = Block(opened.path())
            out.append(block)
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    tags = tags_of(page)
    found = next(tags, None)
    while found is not None:
        start, end, closing, tag, attributes = found
        text(page[at:start])
        at, skip = end, None
        if not tag:
            pass
        elif tag == "br":
            text(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif closing:
            block = None
            if tag not in HIDDEN_TAGS and opened.places.get(tag):
                opened.cut(opened.places[tag][-1])
        elif tag in VOID:
            block = None
        elif tag == "head":
            pass
        elif tag in HIDDEN_TAGS:
            block = block if tag == "svg" else None
            if not attributes.endswith("/"):
                close = re.compile(f"</{tag}(?![a-z0-9-])", re.I).search(page, at)
                at = skip = (page.find(">", close.end()) + 1 if close else 0) or len(page)
        else:
            block = None
            if opened.stack and opened.stack[-1][0] == "p":
                opened.cut(len(opened.stack) - 1)
            if tag in ENDS:
                ended, within = ENDS[tag]
                place = opened.innermost(ended)
                if place > opened.innermost(within):
                    opened.cut(place)
            if not attributes.endswith("/"):
                opened.push(tag, attributes)
        try:
            found = next(tags) if skip is None else tags.send(skip)
        except StopIteration:
            found = None
    text(page[at:])
    kept = []
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def _shape(b: Block, k: int, n: int) -> list[float]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    stops = sum(b.text.count(c) for c in ".!?,;:")
    return [
        np.log1p(size) / 8, min(1.0, b.linked / max(1, sum(map(len, b.parts)))), min(1.0, 5 * stops / words), float(b.text[-1] in ".!?\"'”»"), k / n, 1 - k / n,
        sum(map(len, _UPPERS.findall(b.text))) / size, sum(map(len, _NUMBERS.findall(b.text))) / size, min(1.0, n / 50),
    ]


@dataclass
class Encoded:
    """A page's blocks as bags of hashed path names and words, and numbers on their shape."""

    paths: list[np.ndarray]
    words: list[np.ndarray]
    shape: np.ndarray


def encode(blocks: list[Block]) -> Encoded:
    paths, words = [], []
    for b in blocks:
        paths.append(np.array(b.path or [0], np.int64))
        own = set(b.text.lower().split())
        words.append(np.array([zlib.crc32(w.encode()) % WORD_BUCKETS for w in sorted(own)], np.int64))
    n = len(blocks)
    return Encoded(paths, words, np.array([_shape(b, k, n) for k, b in enumerate(blocks)], np.float32).reshape(-1, SHAPE))


def _means(table: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in bags])
    sums = np.add.reduceat(table[np.concatenate(bags)], np.cumsum(sizes) - sizes)
    return sums / np.sqrt(sizes)[:, None]


class BlockLabeller:
    """Embeddings of paths and words, an LSTM forwards and one backwards over the page's blocks, a logistic output for each block."""

    def __init__(self, seed: int = 19):
        rng = np.random.default_rng(seed)
        width = 2 * EMBEDDING + SHAPE
        self.p = {"path": rng.normal(0, 0.2, (PATH_BUCKETS, EMBEDDING)), "word": rng.normal(0, 0.05, (WORD_BUCKETS, EMBEDDING))}
        for way in "fb":
            self.p[way + "x"] = rng.normal(0, 0.2, (width, 4 * HIDDEN))
            self.p[way + "h"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.p[way + "c"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p["out"] = rng.normal(0, 0.2, 2 * HIDDEN + width)
        self.p["bias"] = np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def _run(self, pages: list[Encoded]):
        """Raw outputs of all blocks of the pages, and what training needs. Pages must have blocks, longest pages first."""
        sizes = np.array([len(p.paths) for p in pages])
        x = np.concatenate([_means(self.p["path"], [b for p in pages for b in p.paths]), _means(self.p["word"], [b for p in pages for b in p.words]), np.concatenate([p.shape for p in pages])], 1)
        starts = np.cumsum(sizes) - sizes
        hidden, kept = np.zeros((len(x), 2 * HIDDEN), np.float32), {}
        for way, side in (("f", 0), ("b", HIDDEN)):
            z = x @ self.p[way + "x"] + self.p[way + "c"]
            h, c = np.zeros((len(pages), HIDDEN), np.float32), np.zeros((len(pages), HIDDEN), np.float32)
            steps = []
            for t in range(sizes[0]):
                n = int(np.searchsorted(-sizes, -t, "left"))  # pages with more than t blocks
                at = starts[:n] + t if way == "f" else starts[:n] + sizes[:n] - 1 - t
                i, f, o, g = self._gates(z[at] + h[:n] @ self.p[way + "h"])
                before = h[:n], c[:n]
                cell = f * c[:n] + i * g
                h, c = o * np.tanh(cell), cell
                hidden[at, side : side + HIDDEN] = h
                steps.append((at, i, f, o, g, cell, *before))
            kept[way] = steps
        top = np.concatenate([hidden, x], 1)
        return top @ self.p["out"] + self.p["bias"][0], top, x, kept

    def labels(self, pages: list[Encoded]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        order = sorted((k for k, p in enumerate(pages) if p.paths), key=lambda k: -len(pages[k].paths))
        out = [np.empty(0)] * len(pages)
        if order:
            own = [pages[k] for k in order]
            raw = self._run(own)[0]
            cuts = np.cumsum([len(p.paths) for p in own])[:-1]
            for k, part in zip(order, np.split(1 / (1 + np.exp(-np.clip(raw, -30, 30))), cuts), strict=True):
                out[k] = part
        return out

    def _gradients(self, pages: list[Encoded], truth: np.ndarray) -> dict[str, np.ndarray]:
        raw, top, x, kept = self._run(pages)
        e = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - truth) / len(truth)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = top.T @ e, e.sum(keepdims=True)
        g_top = e[:, None] * self.p["out"]
        gx = g_top[:, 2 * HIDDEN :].copy()
        for way, side in (("f", 0), ("b", HIDDEN)):
            gz_all = np.zeros((len(x), 4 * HIDDEN), np.float32)
            gh, gc = np.zeros((0, HIDDEN), np.float32), np.zeros((0, HIDDEN), np.float32)
            for at, i, f, o, c_in, cell, h0, c0 in reversed(kept[way]):
                grown = len(at) - len(gh)
                gh, gc = (np.concatenate([y, np.zeros((grown, HIDDEN), np.float32)]) for y in (gh, gc))
                gh = gh + g_top[at, side : side + HIDDEN]
                tanh = np.tanh(cell)
                gc = gc + gh * o * (1 - tanh**2)
                gz = np.concatenate([gc * c_in * i * (1 - i), gc * c0 * f * (1 - f), gh * tanh * o * (1 - o), gc * i * (1 - c_in**2)], 1)
                g[way + "h"] += h0.T @ gz
                gz_all[at] = gz
                gh, gc = gz @ self.p[way + "h"].T, gc * f
            g[way + "x"], g[way + "c"] = x.T @ gz_all, gz_all.sum(0)
            gx += gz_all @ self.p[way + "x"].T
        for name, cut, bags in (("path", slice(0, EMBEDDING), [b for p in pages for b in p.paths]), ("word", slice(EMBEDDING, 2 * EMBEDDING), [b for p in pages for b in p.words])):
            sizes = np.array([len(b) for b in bags])
            np.add.at(g[name], np.concatenate(bags), np.repeat(gx[:, cut] / np.sqrt(sizes)[:, None], sizes, axis=0))
        return g

    def fit(self, pages: list[tuple[Encoded, np.ndarray]], epochs: int = EPOCHS) -> BlockLabeller:
        rng = np.random.default_rng(23)
        past = {k: np.full_like(v, 1e-5) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 16):
                own = sorted((pages[k] for k in order[at : at + 16]), key=lambda p: -len(p[1]))
                g = self._gradients([p for p, _ in own], np.concatenate([y for _, y in own]))
                for k, v in g.items():
                    past[k] += v * v
                    self.p[k] -= RATE * v / np.sqrt(past[k])
        return self


class Layouts:
    """Generated pages of many layouts: (html, marks), where each text block is known to be main text or not."""

    MAIN = ["<article>", "<main>", '<main><article class="post">', '<div class="content">', '<div class="post-content entry">', '<div id="main"><div class="article-body">', '<section class="story">', '<div class="entry-content">', '<div role="main">', '<div class="page"><div id="content" class="text body">', '<div class="container"><article id="post">']
    SIDE = {
        "nav": ["<nav>", '<nav class="menu">', '<div class="navbar nav">', '<ul class="navigation menu">', '<div id="menu">', '<div class="breadcrumbs">', '<div class="topbar">', '<nav role="navigation">'],
        "header": ["<header>", '<header class="site header">', '<div id="header">', '<div class="masthead banner">', '<div class="site-header">', '<div role="banner">'],
        "footer": ["<footer>", '<div id="footer">', '<div class="footer copyright">', '<footer class="site-footer">', '<div class="bottom legal">', '<div role="contentinfo">'],
        "aside": ["<aside>", '<div class="sidebar">', '<div id="side" class="widget">', '<aside class="related">', '<div class="related-posts">', '<div class="widget-area">', '<div class="recommended more-stories">', '<div role="complementary">', '<section class="trending popular">', '<div class="author-bio about">'],
        "ad": ['<div class="ad">', '<div class="ads advert">', '<div class="advertisement">', '<div class="sponsored promo">', '<ins class="adsbygoogle ad">', '<section class="ad-slot">', '<div id="banner-ad">', '<p class="ad">', '<aside class="promo">', '<div class="sponsor">'],
        "notice": ['<div class="cookie-notice">', '<div id="cookies" class="consent">', '<div class="popup modal">', '<div class="notice">', '<div class="newsletter subscribe">', '<div class="alert gdpr">', '<div role="alert">', '<div role="dialog">', '<div class="paywall message">', '<section class="banner-notice">'],
        "form": ["<form>", '<form class="search">', '<form id="login">', '<form action="/subscribe" class="signup">', '<div class="contact-form"><form>'],
        "comments": ['<div class="comments">', '<section id="comments">', '<ol class="comment-list">', '<div class="comment-thread discussion">', '<div id="disqus" class="replies">', '<section class="reader-comments">', '<div class="responses">', '<ul class="commentlist">'],
        "share": ['<div class="share social">', '<ul class="share-buttons">', '<div class="tags meta">', '<div class="pagination pager">'],
    }

    def __init__(self, seed: int = 29):
        self.rng = np.random.default_rng(seed)
        syllables = [a + b for a in "b c d f g h l m n p r s t v w th st".split() for b in "a e i o u ar en ion".split()]
        self.vocabulary = ["".join(self.rng.choice(syllables, self.rng.integers(1, 4))) for _ in range(1500)]

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.pick(self.vocabulary) for _ in range(int(self.rng.integers(low, high))))

    def prose(self) -> str:
        if self.rng.random() < 0.25:
            return self.words(1, 5).capitalize() + self.pick([".", "", " |"])
        return " ".join(self.words(3, 16).capitalize() + self.pick([".", ".", ".", "?", ","]) for _ in range(int(self.rng.integers(1, 7))))

    def close(self, opened: str) -> str:
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))

    def side(self, kind: str) -> list[tuple[str, int | None]]:
        opened = self.pick(self.SIDE[kind])
        rows: list[tuple[str, int | None]] = [(opened, None)]
        item = lambda text, tag="p": rows.extend([(f"<{tag}>", None), (text, 0), (f"</{tag}>", None)])
        links = lambda low, high: [f'<a href="/{self.words(1, 2)}">{self.words(1, 4)}</a>' for _ in range(int(self.rng.integers(low, high)))]
        if kind in ("nav", "share") or kind in ("aside", "footer", "header") and self.rng.random() < 0.5:
            if not opened.startswith(("<ul", "<ol")):
                rows.append(("<ul>", None))
                opened += "<ul>"
            for link in links(2, 8):
                item(link, "li")
        elif kind == "form":
            for _ in range(int(self.rng.integers(1, 4))):
                item(f"<label>{self.words(1, 4)}</label> <input name=q>", self.pick(["div", "p", "fieldset"]))
            item(self.words(1, 3), "button")
        elif kind == "comments":
            for _ in range(int(self.rng.integers(1, 5))):
                tag = "li" if opened.startswith(("<ol", "<ul")) else self.pick(['div class="comment"', "article", "div", 'div class="reply"'])
                rows.append((f"<{tag}>", None))
                if self.rng.random() < 0.6:
                    item(self.words(1, 3), self.pick(["div", "h4", "p"]))
                item(self.prose())
                rows.append((f"</{tag.split()[0]}>", None))
        elif self.rng.random() < 0.5:
            rows.append((self.pick([self.prose, lambda: self.words(2, 12), lambda: "&copy; " + self.words(1, 6) + "."])(), 0))
        else:
            if self.rng.random() < 0.4:
                item(self.words(1, 5), self.pick(["h2", "h3", "h4"]))
            for _ in range(int(self.rng.integers(1, 4))):
                item(self.prose(), self.pick(["p", "p", "div", "li"]))
        rows.append((self.close(opened), None))
        return rows

    def page(self) -> tuple[str, list[int]]:
        rows: list[tuple[str, int | None]] = []
        chance = self.rng.random
        for kind, share in (("notice", 0.25), ("header", 0.55), ("nav", 0.65), ("ad", 0.45), ("share", 0.15), ("form", 0.15)):
            if chance() < share:
                rows += self.side(kind)
        before = chance() < 0.2
        if before:
            rows += self.side("aside")
        opened = self.pick(self.MAIN)
        rows.append((opened, None))
        if chance() < 0.75:
            rows += [("<h1>", None), (self.words(2, 12).capitalize(), 1), ("</h1>", None)]
        for _ in range(int(self.rng.integers(1, 14))):
            roll = chance()
            if roll < 0.06:
                rows += self.side(self.pick(["ad", "share", "notice", "aside", "form", "ad"]))
            elif roll < 0.12:
                tag = self.pick(["h2", "h3"])
                rows += [(f"<{tag}>", None), (self.words(1, 8).capitalize(), 1), (f"</{tag}>", None)]
            elif roll < 0.18:
                tag = self.pick(["ul", "ol"])
                rows.append((f"<{tag}>", None))
                for _ in range(int(self.rng.integers(1, 5))):
                    rows += [("<li>", None), (self.prose(), 1), ("</li>" if chance() < 0.8 else "", None)]
                rows.append((f"</{tag}>", None))
            elif roll < 0.22:
                rows += [("<blockquote><p>", None), (self.prose(), 1), ("</p></blockquote>", None)]
            elif roll < 0.25:
                rows += [("<table><tr><td>", None), (self.words(1, 5), 1), ("</td><td>", None), (self.words(1, 5), 1), ("</td></tr></table>", None)]
            else:
                text = self.prose()
                if chance() < 0.15:
                    text = f'{text} <a href="/x">{self.words(1, 4)}</a> {self.words(1, 5)}.'
                if chance() < 0.1:
                    text = f"<b>{text}<br>"
                tag = self.pick(["p", "p", "p", "p", "div", "pre"])
                rows += [(f"<{tag}>", None), (text, 1), (f"</{tag}>" if chance() < 0.85 or tag != "p" else "", None)]
        if chance() < 0.2:
            rows += self.side(self.pick(["comments", "share", "aside"]))
        rows.append((self.close(opened), None))
        for kind, share in (("aside", 0.0 if before else 0.4), ("comments", 0.35), ("form", 0.15), ("ad", 0.2), ("nav", 0.1), ("footer", 0.75), ("notice", 0.15)):
            if chance() < share:
                rows += self.side(kind)
        body = "".join(f"\x02{mark}{text}\x03" if mark is not None else text for text, mark in rows)
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>", [m for _, m in rows if m is not None]

    def labelled(self) -> tuple[Encoded, np.ndarray] | None:
        """A page's encoded blocks with their marks, which stand in the text until the page is parsed."""
        blocks = blocks_of(self.page()[0])
        marks = []
        for b in blocks:
            marks.append(int("\x021" in b.text))
            b.text = re.sub(r"\x02[01]|\x03", "", b.text).strip() or "-"
            b.parts = [re.sub(r"\x02[01]|\x03", "", p) for p in b.parts]
        return (encode(blocks), np.array(marks, np.float32)) if blocks else None


@lru_cache(maxsize=2)
def train(pages: int = TRAIN_PAGES) -> BlockLabeller:
    """A labeller trained on generated layouts; no table has labels for pages. Deterministic, so it is fitted once in a process."""
    made = Layouts()
    rows = [r for r in (made.labelled() for _ in range(pages)) if r is not None]
    return BlockLabeller().fit(rows)


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """pages (html and others) with a column text: the main blocks of the whole page in order, joined by line feeds.

    A page without main blocks, an empty one and a null have an empty text. A column text that pages has already is
    replaced; all others stay. Broken markup is read as tags_of says; repeated rows come as often as they are there.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            out = []
            for at in range(0, len(html), PAGES):
                parsed = [blocks_of(x or "") for x in html.iloc[at : at + PAGES]]
                for blocks, likely in zip(parsed, shared.value.labels([encode(b) for b in parsed]), strict=True):
                    out.append("\n".join(b.text for b, p in zip(blocks, likely, strict=True) if p >= 0.5))
            yield pd.Series(out, dtype=object)

    return pages.withColumn("text", F.pandas_udf(run, "string")("html"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of the main text of every page."""
    found = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
