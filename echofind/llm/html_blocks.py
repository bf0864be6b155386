"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat sequence of text blocks.  A block is described by its word count and
link density, those of the blocks before and after it, by what encloses it, and by a hint from the
class names around it.  A decision
tree, trained on the labelled table that ``labelled`` makes, tells article blocks from the
rest.

Cases: a null or empty page has an empty text; markup that ends early, tags without an end (a script or style without one goes on to the end) and
unknown references are taken as they stand; a null id or url is passed on; repeated rows give
one result each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .scratch import modest

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
#: Names of elements, by their part in a page.
#: Raw text: without an end tag it goes on to the end of the page.
RAW = {"script", "style"}
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "math", "audio", "video", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that close by themselves and enclose nothing of note.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body"}
MAIN = {"article", "main"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "fieldset", "label"}
#: Words of class names that usually mark the frame of a page, and words that often stand in layouts of articles too.
STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|comments?|replies|disqus|respond|"
    r"side-?bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|newsletter|subscri\w+|signup|login|footer|masthead|site-?header|topbar|toolbar|search|gdpr|skip-link)(?=$|[\s_-])",
    re.IGNORECASE,
)
WEAK = re.compile(r"(?:^|[\s_-])(?:widget|share|sharing|social|related|recommend\w*|tags|legal|disclaimer|copyright)(?=$|[\s_-])", re.IGNORECASE)
ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu|menubar)$", re.IGNORECASE)
BODY_HINT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in UNSEEN}


@dataclass
class Block:
    text: str
    words: int
    linked: float
    main: bool
    framed: bool
    hint: int
    heading: bool


def _kind(name: str, attributes: str, in_main: bool) -> tuple[bool, bool, int]:
    """Whether an element holds the article, whether it is part of the frame around it, and what its class names hint at: 2 the frame, 1 perhaps, 0 nothing."""
    main, framed, hint = name in MAIN, name in FRAME or name == "header" and not in_main, 0
    for key, *value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(value)
        if key in ("class", "id"):
            strong, weak, body = (len(p.findall(value)) for p in (STRONG, WEAK, BODY_HINT))
            if strong + weak > body:
                hint = max(hint, 2 if strong else 1)
            elif body and name in ("div", "section", "td"):
                main = True
        elif key == "role":
            framed |= bool(ROLE.match(value))
            main |= value.lower() in ("main", "article")
        elif key == "style" and HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
            framed = True
    return main, framed or bool(re.search(r"\shidden(?:\s|$)", attributes)), hint


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked, link = 0, False
    stack: list[tuple[str, bool, bool, int]] = []
    heading = ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, min(1.0, linked / max(1, len(text))), *(stack[-1][1:] if stack else (False, False, 0)), bool(heading)))
            pieces.clear()
        linked = 0

    at, end = 0, len(page)
    last_close = dict.fromkeys(UNSEEN, end)
    while at < end:
        m = MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            pieces.append(piece)
            if link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = (m[1] or m[4]) == "/"
        if name == "a":
            link = not closing
        if name in INLINE:
            continue
        flush()
        if name in UNSEEN:
            if not closing and not m[0].endswith("/>"):
                close = CLOSE[name].search(page, at) if at <= last_close[name] else None
                if not close:
                    last_close[name] = -1  # nor is there one further on
                    if name in RAW:
                        at = end
                elif name in RAW or not any(f"</{s[0]}" in page[at : close.start()].lower() for s in stack):
                    at = close.end()
                # else the element ends before its tag does: what it seems to hold is read as the rest of the page
            continue
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            heading = "" if closing else name
        if name in VOID or name in LOOSE:
            attributes = m[3] or m[6] or ""
            if name in VOID or closing or "class" not in attributes and "id" not in attributes and "hidden" not in attributes and "none" not in attributes:
                if closing and stack and any(s[0] == name for s in stack[-3:]):
                    while stack and stack.pop()[0] != name:
                        pass
                continue
        link = False
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not m[0].endswith("/>"):
            if name in LOOSE and stack and stack[-1][0] == name:
                stack.pop()
            was_main, was_framed, was_hint = stack[-1][1:] if stack else (False, False, 0)
            main, framed, hint = _kind(name, m[3] or m[6] or "", was_main)
            stack.append((name, was_main or main, was_framed or framed, max(was_hint, hint)))
    flush()
    return out


FEATURES = ("words", "linked", "words before", "linked before", "words after", "linked after", "in main", "in frame", "class hint", "heading", "page has main")


def features(found: list[Block]) -> np.ndarray:
    """A row per block; outside the page there are no words and no links."""
    own = np.array([(min(b.words, 500), b.linked) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    whole = any(b.main and not b.framed for b in found)
    flags = np.array([(b.main, b.framed, b.hint, b.heading, whole) for b in found], float).reshape(-1, 5)
    return np.concatenate([own, np.concatenate([edge, own[:-1]])[: len(own)], np.concatenate([own[1:], edge])[: len(own)], flags], axis=1)


def labelled(pages: int = 120, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table, by rule: blocks of sketched pages, with and without an article element, and whether each is article text."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(pages):
        whole = k % 2 == 0
        page: list[tuple[Block, bool]] = []

        def add(words: int, linked: float, main: bool, framed: bool, hint: int, heading: bool, good: bool, page=page) -> None:
            page.append((Block("", words, linked, main, framed, hint, heading), good))

        def frame(words: int, linked: float, main: bool, add=add) -> None:
            """A block of the frame, by its element or its class."""
            element = rng.random() < 0.5
            add(words, linked, main, element, rng.choice((0, 2)) if element else 2, False, False)

        weak = 1 if rng.random() < 0.3 else 0  # the article stands in a container with a doubtful class
        for _ in range(rng.randint(2, 8)):
            if rng.random() < 0.6:
                frame(rng.randint(1, 3), 1.0, False)
            else:
                add(rng.randint(1, 3), 1.0, False, False, 0, False, False)
        if rng.random() < 0.7:
            frame(rng.randint(3, 60), rng.choice((0.0, 0.0, 0.2)), rng.random() < 0.2)
        if whole or rng.random() < 0.5:
            add(rng.randint(2, 25), 0.0, whole, False, 0, True, True)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if whole and kind < 0.25:
                add(rng.randint(1, 6), rng.choice((0.0, 0.0, 0.5, 1.0)), True, False, 0, False, True)
            elif whole and kind < 0.34:
                frame(rng.randint(3, 90), rng.choice((0.0, 0.0, 1.0)), True)
            elif kind < 0.42:  # links to share, tags, related pages
                add(rng.randint(1, 12), rng.choice((0.6, 1.0, 1.0)), whole, False, 1, False, False)
            elif not whole and kind < 0.5:
                add(rng.randint(3, 9), 0.0, False, False, 0, False, True)
            else:
                add(rng.randint(12, 160), rng.choice((0.0, 0.0, 0.05, 0.25)), whole, False, weak, False, True)
        for _ in range(rng.randint(0, 5)):
            add(rng.randint(1, 8), rng.choice((1.0, 1.0, 0.8)), False, rng.random() < 0.5, 0, False, False)
        if whole and rng.random() < 0.5:
            add(rng.randint(15, 60), rng.choice((0.0, 0.1)), False, False, 0, False, False)
        for _ in range(rng.randint(0, 3)):
            frame(rng.randint(5, 90), 0.0, rng.random() < 0.3)
        add(rng.randint(3, 40), rng.choice((0.0, 0.4)), False, True, 0, False, False)
        rows.append(features([b for b, _ in page]))
        labels += [good for _, good in page]
    return np.concatenate(rows), np.array(labels)


class Tree:
    """A binary decision tree by Gini impurity; ties go to the first feature and the lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3):
        self.value = bool(2 * y.sum() >= len(y)) if len(y) else False
        self.feature = None
        if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
            return
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, good = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = good[:-1] / n, (good[-1] - good[:-1]) / (len(y) - n)
            cost = n * 2 * left * (1 - left) + (len(y) - n) * 2 * right * (1 - right)
            cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        _, self.feature, self.cut = best
        if self.feature is not None:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        out = np.empty(len(x), bool)
        low = x[:, self.feature] <= self.cut
        out[low], out[~low] = self.low(x[low]), self.high(x[~low])
        return out


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None, tree: Tree) -> str:
    """The article of a page: its blocks, joined by line feeds."""
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, good in zip(found, tree(features(found)), strict=True) if good)


def extracted(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Per page row: ``page_id, url, text, n_chars``."""
    modest(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(tree or default_tree())
    some = pages.select("page_id", "url", "html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch.column(2)):
                n = part.rows.stop - part.rows.start
                texts = [main_text(p, shared.value) for p in batch.column(2).slice(part.rows.start, n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(part.rows.start, n) for c in batch.columns[:2]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = [some.schema[i].dataType.simpleString() for i in range(2)]
    return some.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
