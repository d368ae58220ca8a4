"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: stretches of text between the borders of block elements,
with the tags, class and id words of all their ancestors. Each block gets a label (main text
or not); labels of neighbouring blocks depend on each other. Features are ancestor tags and
names, place in the page, size, share of linked text, punctuation and marker words. The
weights are fitted by gradient steps on the exact log likelihood (forward and backward sums)
of labelled pages, and pages are decoded by Viterbi. The labelled pages are written here, in
many layouts (``labelled_pages``): TRAIN_PAGES of them, whatever the size of the input.

Each page is worked on by itself, so nothing is shuffled; the weights are broadcast and
their number is bounded by the labelled pages. Null and empty html give an empty text. Broken
and truncated markup is read as far as it goes; pages of any length are read whole. Repeated
rows give repeated results; an empty table gives an empty table; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Remembered, batch_rows, to_batches, whole_text

TRAIN_PAGES = 400
ROUNDS = 12

#: Fixed values of HTML: elements that run inside a line of text, that have no content, whose
#: content is no text of the page, and that end an open paragraph by their own start.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template svg math iframe object canvas audio video map noframes".split())
CLOSED_BY_ITSELF = frozenset("p li dt dd option tr td th".split())
#: Start tags in front of which an open element of the first kind has ended.
ENDED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_BLANK = re.compile(r"\s+")
_NAME = re.compile(r"[a-zA-Z]+")
MARKERS = frozenset("cookie cookies copyright subscribe newsletter advertisement sponsored login reply replied comment comments share menu privacy rights reserved".split())


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


class BlockReader(HTMLParser):
    """Collects the leaf blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []  # tag, tag with class and id words
        self.unseen = 0
        self.parts: list[str] = []
        self.linked, self.links = 0, 0
        self.path: tuple[str, ...] = ()
        self.blocks: list[Block] = []

    def _end_block(self) -> None:
        if self.parts:
            text = _BLANK.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append(Block(text, self.path, min(1.0, self.linked / len(text))))
            self.parts, self.linked = [], 0

    def _pop_to(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self._end_block()
            self._pop_closed(tag)
        if tag in VOID:
            return
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [w.lower() for w in _NAME.findall(value)]
        self.open.append((tag, " ".join(names)))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def _pop_closed(self, tag: str) -> None:
        """Elements whose end tag was left out."""
        borders = ENDED_BY.get(tag)
        for k in range(len(self.open) - 1, -1, -1):
            held = self.open[k][0]
            if held == "p" or (borders and held == tag) or (tag in ("dt", "dd") and held in ("dt", "dd")) or (tag in ("td", "th") and held in ("td", "th")):
                self._pop_to(k)
                return
            if held not in INLINE and (not borders or held in borders or held not in CLOSED_BY_ITSELF):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop_to(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section the parser does not know, or that does not end, is a bogus comment, as in browsers."""
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:
            end = -1
        return self.parse_bogus_comment(i) if end < 0 else end

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if not self.parts:
            self.path = tuple(names for tag, names in self.open if tag not in INLINE)
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def blocks_of(html: str) -> list[Block]:
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    reader._end_block()
    return reader.blocks


def path_features(path: tuple[str, ...]) -> list[str]:
    out = {"depth=" + str(min(len(path), 8))}
    for k, names in enumerate(path):
        tag, *words = names.split(" ")
        out.add("in=" + tag)
        out.update("name=" + w for w in words)
        if k == len(path) - 1:
            out.add("leaf=" + tag)
            out.update("own=" + w for w in words)
        if k == len(path) - 2:
            out.add("parent=" + tag)
    return sorted(out)


def text_features(block: Block, number: int, of: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    size = min(6, int(math.log2(words)))
    ends = text[-1] in ".!?:;\"'…”»。"
    out = [
        f"words={size}",
        f"linked={int(block.linked * 3)}",
        f"ends={ends}",
        f"stops={min(3, sum(text.count(c) for c in '.,;!?') * 8 // (words + 1))}",
        f"place={min(9, number * 10 // of)}",
        "always",
    ]
    if number < 2:
        out.append(f"first={number}")
    if of - number < 3:
        out.append(f"last={of - number}")
    if "©" in text or "(c)" in text.lower()[:8]:
        out.append("sign=copyright")
    if words <= 30:
        out += ["marker=" + w for w in {w.lower() for w in _NAME.findall(text)} & MARKERS]
    return out


class Field:
    """Weights of a chain with two labels: features, neighbouring labels, first label."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}  # for label 1; label 0 has none
        self.next = np.zeros((2, 2))
        self.paths = Remembered(self._of_path, 100_000)

    def _of_path(self, path: tuple[str, ...]) -> float:
        return sum(self.weights.get(f, 0.0) for f in path_features(path))

    def emissions(self, blocks: list[Block]) -> list[float]:
        get, n = self.weights.get, len(blocks)
        return [self.paths[b.path] + sum([get(f, 0.0) for f in text_features(b, k, n)]) for k, b in enumerate(blocks)]

    def labels(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not blocks:
            return []
        (a, b), (c, d) = self.next.tolist()
        scores = self.emissions(blocks)
        zero, one, back = 0.0, scores[0], []
        for e in scores[1:]:
            from_zero, from_one = (zero + a >= one + c), (zero + b >= one + d)
            back.append((int(not from_zero), int(not from_one)))
            zero, one = max(zero + a, one + c), max(zero + b, one + d) + e
        label = int(one > zero)
        out = [label]
        for to_zero, to_one in reversed(back):
            label = to_one if label else to_zero
            out.append(label)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fitted(pages: list[tuple[str, list[int]]], rounds: int = ROUNDS, rate: float = 0.3, penalty: float = 1e-3) -> Field:
    """Weights from labelled pages: adaptive gradient steps on the log likelihood."""
    read = []
    names: dict[str, int] = {}
    for html, labels in pages:
        blocks = blocks_of(html)
        features = [[names.setdefault(f, len(names)) for f in path_features(b.path) + text_features(b, k, len(blocks))] for k, b in enumerate(blocks)]
        read.append((features, np.array(labels)))
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-6)
    pair, pair_seen = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = list(range(len(read)))
    shuffled = random.Random(7)
    for _ in range(rounds):
        shuffled.shuffle(order)
        for p in order:
            features, y = read[p]
            n = len(features)
            emit = np.zeros((n, 2))
            emit[:, 1] = [w[f].sum() for f in features]
            ahead, behind = emit.copy(), np.zeros((n, 2))
            for k in range(1, n):
                ahead[k] += _log_sum(ahead[k - 1][:, None] + pair, 0)
            for k in range(n - 2, -1, -1):
                behind[k] = _log_sum(pair + (emit[k + 1] + behind[k + 1])[None, :], 1)
            total = _log_sum(ahead[-1], 0)
            share = np.exp(ahead + behind - total)[:, 1]
            for f, error in zip(features, (y - share).tolist(), strict=True):
                g = error - penalty * w[f]
                seen[f] += g * g
                w[f] += rate * g / np.sqrt(seen[f])
            together = np.zeros((2, 2))
            for k in range(1, n):
                together -= np.exp(ahead[k - 1][:, None] + pair + (emit[k] + behind[k])[None, :] - total)
                together[y[k - 1], y[k]] += 1
            pair_seen += together**2
            pair += rate * together / np.sqrt(pair_seen)
    field = Field()
    field.weights = {name: float(w[k]) for name, k in names.items() if abs(w[k]) > 1e-6}
    field.next = pair
    return field


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages in varied layouts with the label of each leaf block, in page order."""
    r = random.Random(seed)
    letters = "aeiounrstlmdkéüñ"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def line(a: int, b: int, end: str = "") -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + end

    def prose(longest: int = 90) -> str:
        out = []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8))):
            out.append(line(1, max(2, longest // 8), r.choice(("." * 6 + "!?")) if r.random() < 0.95 else ","))
        text = " ".join(out)
        if r.random() < 0.1:
            text = " ".join(w + r.choice(("&amp;&amp;&amp;", "***", "###", "!!")) for w in text.split(" "))
        if r.random() < 0.1:
            text = " | ".join(text.split(" "))
        if r.random() < 0.15:
            text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        return text

    def linked(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n))

    Part = tuple[str, list[int]]

    def nav() -> Part:
        n = r.randint(3, 8)
        a, b = r.choice((("<nav><ul>", "</ul></nav>"), ('<div class="menu"><ul>', "</ul></div>"), ('<ul id="navbar" class="nav">', "</ul>"), ('<div id="topbar"><nav class="navigation"><ul>', "</ul></nav></div>")))
        return a + linked(n) + b, [0] * n

    def header() -> Part:
        inner = f"<a href='/'>{line(1, 3)}</a>" if r.random() < 0.5 else line(1, 5)
        if r.random() < 0.3:
            return f"<header class='{r.choice(('top', 'site', 'head'))}'><h1>{inner}</h1></header>", [0]
        if r.random() < 0.5:
            return f"<header><div class='logo'>{inner}</div><p>{line(2, 8)}</p></header>", [0, 0]
        return f"<div id='{r.choice(('header', 'masthead', 'banner'))}'>{inner}</div>", [0]

    def advert() -> Part:
        name = r.choice(("ad", "ads", "advert", "sponsored", "promo", "banner ad"))
        text = r.choice((line(3, 14, "."), prose(40)))
        return f"<!-- ad --><{(t := r.choice(('div', 'div', 'aside', 'section')))} class=\"{name}\">{text}</{t}>", [0]

    def notice() -> Part:
        name = r.choice(("cookie", "notice", "gdpr consent", "alert", "newsletter", "subscribe", "popup"))
        lead = r.choice(("", "We use cookies. ", "Subscribe to our newsletter. "))
        return f"<div class=\"{name}\"><p>{lead}{prose(40)}</p><button>{line(1, 2)}</button></div>", [0, 0]

    def sidebar() -> Part:
        n = r.randint(2, 6)
        name = r.choice(('<aside class="sidebar">', '<div class="sidebar">', '<div id="related">', "<aside>", '<section class="widget">'))
        tag = re.match(r"<(\w+)", name)[1]
        extra = f"<p>{prose(40)}</p>" if (more := r.random() < 0.5) else ""
        return f"{name}<h3>{line(1, 4)}</h3><ul>{linked(n)}</ul>{extra}</{tag}>", [0] * (n + 1 + more)

    def form() -> Part:
        return f"<form action='/s'><label>{line(1, 3)}</label><input name=q><p>{line(2, 10)}</p><button>{line(1, 2)}</button></form>", [0] * 3

    def comments() -> Part:
        n = r.randint(1, 5)
        name = r.choice(("comments", "comment-list", "discussion", "replies", "responses"))
        inside = "".join(f"<div class='comment'><p>{prose()}</p></div>" if r.random() < 0.6 else f"<li class='comment'>{prose()}</li>" for _ in range(n))
        title = f"<h2>{line(1, 3)}</h2>" if (more := r.random() < 0.6) else ""
        tag = r.choice(("div", "section", "ol"))
        return f"<{tag} {r.choice(('class', 'id'))}='{name}'>{title}{inside}</{tag}>", [0] * (n + more)

    def footer() -> Part:
        text = r.choice((f"&copy; {word()}.example.com &middot; {line(3, 10, '.')}", f"Copyright {word()}. All rights reserved.", line(4, 14, ".")))
        if r.random() < 0.7:
            return f"<footer>{text}</footer>", [0]
        return f"<div id='footer'><p>{text}</p><ul>{linked(2)}</ul></div>", [0] * 3

    def article() -> Part:
        body, labels = [], []
        if r.random() < 0.8:
            body.append(f"<{(h := r.choice(('h1', 'h1', 'h2')))}>{line(1, 12, r.choice(('', '.')))}</{h}>")
            labels.append(1)
        all_divs = r.random() < 0.15
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 14, 25))):
            kind = r.random()
            if all_divs:
                body.append(f"<div>{prose()}</div>")
            elif kind < 0.04:
                body.append(f"<table><tr><td>{line(1, 4)}</td><td>{line(1, 3)}</td></tr></table>")
                labels.append(1)
            elif kind < 0.07:
                body.append(f"<figure><img src='/{word()}'><figcaption>{line(2, 9, '.')}</figcaption></figure>")
            elif kind < 0.72:
                body.append(f"<p>{prose()}</p>")
            elif kind < 0.8:
                body.append(f"<p><b>{prose()}<br>")
            elif kind < 0.86:
                body.append(f"<h{(k := r.randint(2, 4))}>{line(1, 7)}</h{k}>")
            elif kind < 0.91:
                body.append(f"<blockquote>{prose()}</blockquote>")
            elif kind < 0.95:
                body.append(f"<ul><li>{prose(30)}</li><li>{line(1, 9)}</li></ul>")
                labels.append(1)
            else:
                body.append(f"<div>{prose()}</div>")
            labels.append(1)
            if r.random() < 0.06:
                more, zero = r.choice((advert, notice, form))()
                body.append(more)
                labels += zero
        if not labels:
            body.append(f"<p>{prose()}</p>")
            labels.append(1)
        a, b = r.choice(
            (("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"),
             ('<div id="main"><div class="entry">', "</div></div>"), ('<section class="article-body">', "</section>"), ("<div>", "</div>"), ('<div class="text">', "</div>"), ('<div class="story">', "</div>"), ('<div id="page-content">', "</div>"), ('<div class="post"><div>', "</div></div>"))
        )
        if r.random() < 0.1:
            more, zero = comments()
            body.append(more)
            labels += zero
        return a + "".join(body) + b, labels

    pages = []
    for _ in range(count):
        title = line(1, 8)
        html = f'<!DOCTYPE html><html lang="{word()[:2]}"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        labels = [0]
        front = r.sample((header, nav, advert, notice, sidebar, form), r.randint(0, 4))
        back = r.sample((sidebar, comments, form, advert, notice, footer, nav), r.randint(0, 4)) + ([footer] if r.random() < 0.6 else [])
        wrap = r.random() < 0.25
        html += '<div class="page">' * wrap
        for part in [*front, article, *back]:
            text, kinds = part()
            html += text
            labels += kinds
        html += "</div>" * wrap
        html += r.choice(("</body></html>", "", "</body></html>"))
        if len(blocks_of(html)) == len(labels):
            pages.append((html, labels))
    return pages


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    field = field or fitted(labelled_pages())
    shared = spark.sparkContext.broadcast((field.weights, field.next))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.weights, own.next = shared.value
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for batch in batches:
            out = []
            for page, url, body in batch_rows(batch, "page_id", "url", "body"):
                blocks = blocks_of(body.decode("utf-8", "replace"))
                text = "\n".join(b.text for b, label in zip(blocks, own.labels(blocks), strict=True) if label)
                out.append((page, url, text, len(text)))
            yield to_batches(schema, zip(*out, strict=True) if out else [[]] * 4)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), whole_text(html_col).alias("body"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
