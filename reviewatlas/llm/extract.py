"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block elements. Each has features of its
ancestors (tag names, words of class and id) and of its text (length, share of linked characters,
ending, cue words, place). The field has a weight per feature and one per pair of neighbouring labels; Viterbi's
path labels the blocks as main text or not.

The tables hold no labelled pages, so they are made: a bounded sample of pages, labelled by its own
``article`` elements, and new pages that set the same articles between menus, notices, sidebars, adverts, forms
and comments in other layouts, where the labels are known.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import bounded_sample, slices

#: Pages that the field is fitted on: so many, the first by a hash of the id, of at most so many characters and blocks.
SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_BLOCKS = 300, 65536, 400
#: New layouts made of each of them.
LAYOUTS = 2

#: Fixed by HTML: elements without an end tag, with raw text, and those that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math select option button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
START = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
STOP = re.compile("[>\"']")
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
#: Mark of the main text in pages made for training; never a feature.
MARK = "data-main-text"
#: Words that speak of a page rather than of its subject.
CUES = frozenset(
    "advertisement comment comments commented cookie cookies copyright login menu newsletter notice policy privacy related reply rights share sign sponsored subscribe terms".split()
)


class Above:
    """The features of a block's ancestors as a chain: those that an element adds to the ones around it. Blocks share the chain, so
    it takes as much room as the page."""

    __slots__ = ("around", "names", "weight")

    def __init__(self, around: Above | None = None, names: tuple[str, ...] = ()):
        self.around, self.names, self.weight = around, names, None

    def all(self) -> frozenset[str]:
        found, at = [], self
        while at is not None:
            found += at.names
            at = at.around
        return frozenset(found)


@dataclass
class Block:
    """A leaf block: its text as it is read, its ancestors' features, its own tag and those just above, linked characters, and its label in training."""

    text: str
    above: Above
    path: str
    linked: int
    label: bool = False

    @property
    def tag(self) -> str:
        return self.path.rpartition("/")[2]


@dataclass
class _Open:
    name: str
    above: Above
    own: set[str]
    marked: bool


def _behind(page: str, at: int) -> int:
    """The place behind the > that ends a tag, those in quotes skipped; -1 where the page ends first."""
    while (m := STOP.search(page, at)) and m[0] != ">":
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return m.end() if m else -1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order.

    The page is read once from front to back. Where a tag has a quote that never ends, tags end at their first > from there on, quoted or not;
    behind the last > all is text.
    """
    out: list[Block] = []
    if not page:
        return out
    stack = [_Open("", Above(), set(), False)]
    opened: dict[str, int] = {}
    held: dict[str, int] = {}
    unclosed: set[str] = set()
    parts: list[str] = []
    linked, at, end, in_link, quotes = 0, 0, len(page), 0, True

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                path = [o.name for o in stack[-6:] if o.name in BLOCK][-3:]
                out.append(Block(text, stack[-1].above, "/".join(path), linked, stack[-1].marked))
            parts.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal in_link
        for o in stack[depth:]:
            in_link -= o.name == "a"
            opened[o.name] -= 1
            for w in o.own:
                held[w] -= 1
        del stack[depth:]

    while at < end:
        m = START.search(page, at)
        name, stop = (m[2], m.start()) if m else (None, end)
        if m is None:
            behind = end
        elif name:
            behind = _behind(page, m.end()) if quotes else page.find(">", m.end()) + 1 or -1
            if behind < 0 and quotes:
                quotes, behind = False, page.find(">", m.end()) + 1 or -1
        elif m[0] == "<!--":
            behind = page.find("-->", m.end()) + 3
            behind = behind if behind > 2 else end
        else:
            behind = page.find(">", m.end()) + 1 or -1
        if behind < 0:
            stop = behind = end
            name = None
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = behind
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            if opened.get(name):
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                pop(depth)
            continue
        if name in RAW:
            close = None if name in unclosed else CLOSE[name].search(page, at)
            if close is None:
                unclosed.add(name)
            at = close.end() if close else end if name in ("script", "style", "textarea", "title") else at
            continue
        if name in BLOCK:
            flush()
            if stack[-1].name == "p" or any(o.name == "p" for o in stack[-8:]):
                depth = next((d for d in range(len(stack) - 1, max(0, len(stack) - 9), -1) if stack[d].name == "p"), 0)
                if depth:
                    pop(depth)
            if name == "li" and stack[-1].name == "li":
                pop(len(stack) - 1)
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        top, own, attributes = stack[-1], {f"in:{name}"} if name in BLOCK else set(), page[m.end() : behind - 1]
        if attributes:
            for names in NAMES.findall(attributes):
                own.update(f"is:{w}" for w in PARTS.findall("".join(names).lower()))
        new = tuple(sorted(w for w in own if not held.get(w)))
        for w in own:
            held[w] = held.get(w, 0) + 1
        opened[name] = opened.get(name, 0) + 1
        stack.append(_Open(name, Above(top.above, new) if new else top.above, own, top.marked or MARK in attributes))
        in_link += name == "a"
    flush()
    return out


def _bucket(n: float, edges: tuple[float, ...]) -> int:
    return sum(n >= e for e in edges)


def features(found: list[Block]) -> list[list[str]]:
    """Text features of each block; the ancestors' come with ``above``."""
    rows = []
    for i, b in enumerate(found):
        low = b.text.lower()
        n = b.text.count(" ") + 1
        cues = CUES.intersection(PARTS.findall(low)) if n <= 40 else ()
        rows.append([
            "bias", f"path:{b.path}", f"tag:{b.tag}", f"words:{_bucket(n, (2, 4, 8, 16, 32, 64))}", f"links:{_bucket(b.linked / len(b.text), (0.05, 0.35, 0.8))}",
            f"ends:{b.text[-1] if b.text[-1] in '.!?:…»”' else 'other'}", f"from start:{_bucket(i, (1, 3, 8))}", f"from end:{_bucket(len(found) - 1 - i, (1, 3, 8))}",
            *(["mark:©"] if "©" in low else []), *(["cue"] if cues else []), *(f"cue:{c}" for c in cues),
        ])
    return rows


@dataclass
class Field:
    """Weight of each feature for main text, of each step (label before, label) and of the first label."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))


def viterbi(unary: list[float], model: Field) -> list[int]:
    """The likeliest labels, given each block's weight for main text. Ties go to the label 0."""
    if not unary:
        return []
    (s00, s01), (s10, s11) = model.steps.tolist()
    a, b = float(model.first[0]), float(model.first[1]) + unary[0]
    back = []
    for u in unary[1:]:
        to0, to1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 >= b + s11 else (1, b + s11)
        back.append((to0[0], to1[0]))
        a, b = to0[1], to1[1] + u
    label = int(b > a)
    path = [label]
    for pair in reversed(back):
        label = pair[label]
        path.append(label)
    return path[::-1]


def fit_field(pages: list[list[Block]], rounds: int = 100, rate: float = 0.2, ridge: float = 2e-4) -> Field:
    """Greatest regularised likelihood by Adam, from labelled pages. All pages step through the chain together."""
    pages = [p for p in pages if p]
    if not pages:
        return Field()
    index: dict[str, int] = {}
    cell, feat = [], []
    width = max(map(len, pages))
    y, there = np.zeros((len(pages), width), dtype=np.int64), np.zeros((len(pages), width), dtype=bool)
    for r, page in enumerate(pages):
        for c, (b, own) in enumerate(zip(page, features(page), strict=True)):
            ids = [index.setdefault(f, len(index)) for f in (*own, *sorted(b.above.all()))]
            cell += [r * width + c] * len(ids)
            feat += ids
            y[r, c], there[r, c] = b.label, True
    cell, feat = np.array(cell), np.array(feat)
    n, blocks_ = len(index), there.sum()
    theta, m, v = np.zeros(n + 6), np.zeros(n + 6), np.zeros(n + 6)

    def expected(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of label 1 of each block, of each pair of labels (summed), and of the first labels (summed)."""
        u = np.zeros((len(pages), width, 2))
        u[..., 1] = np.bincount(cell, theta[feat], len(pages) * width).reshape(len(pages), width)
        step, first = theta[n : n + 4].reshape(2, 2), theta[n + 4 :]
        ahead, behind = np.zeros_like(u), np.zeros_like(u)
        ahead[:, 0] = u[:, 0] + first
        for t in range(1, width):
            ahead[:, t] = np.where(there[:, t, None], np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + u[:, t], ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            x = behind[:, t + 1] + u[:, t + 1]
            behind[:, t] = np.where(there[:, t + 1, None], np.logaddexp(x[:, :1] + step[:, 0], x[:, 1:] + step[:, 1]), 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        one = np.where(there, np.exp(np.minimum(0, ahead[..., 1] + behind[..., 1] - z)), 0)
        pair = ahead[:, :-1, :, None] + step + (u + behind)[:, 1:, None, :] - z[..., None, None]
        pairs = np.where(there[:, 1:, None, None], np.exp(np.minimum(0, pair)), 0).sum(axis=(0, 1))
        return one, pairs, np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()])

    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
    seen_first = np.bincount(y[:, 0], minlength=2)
    for k in range(1, rounds + 1):
        one, pairs, first = expected(theta)
        g = np.concatenate([np.bincount(feat, (one - np.where(there, y, 0)).ravel()[cell], n), (pairs - seen_pairs).ravel(), first - seen_first]) / blocks_ + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in index.items()}, theta[n : n + 4].reshape(2, 2), theta[n + 4 :])


#: Elements inside an article that are not its text, by their own markup.
ASIDE = frozenset(f"in:{x}" for x in "nav aside footer form header menu dialog".split()) | frozenset(f"is:{x}" for x in "ad ads advert comment comments cookie notice sidebar share related promo".split())


def own_labels(found: list[Block]) -> list[Block]:
    """Labels of a page by its own ``article`` or ``main`` elements."""
    names = [b.above.all() for b in found]
    return [Block(b.text, b.above, b.path, b.linked, bool(own & {"in:article", "in:main"}) and not own & ASIDE) for b, own in zip(found, names, strict=True)]


#: (element, its class or id) around each kind of part in pages made for training.
MAIN = [("article", ""), ("main", ""), ("div", "post-content"), ("div", "article-body"), ("section", "entry"), ("article", "story"), ("div", "content")]
BEFORE = [("nav", ""), ("header", ""), ("div", "menu"), ("ul", "navigation"), ("div", "header"), ("div", "breadcrumbs"), ("div", "cookie-notice"), ("div", "banner notice"), ("form", "search"), ("div", "cookie-banner"), ("div", "alert"), ("div", "topbar"), ("form", "login")]
AFTER = [("footer", ""), ("div", "footer"), ("aside", ""), ("div", "sidebar"), ("section", "comments"), ("div", "related"), ("form", "newsletter"), ("div", "ad"), ("ol", "comment-list"), ("div", "advertisement sponsored"), ("div", "user-comments"), ("div", "widget"), ("nav", "pagination")]
WITHIN = [("div", "ad"), ("aside", ""), ("div", "advert"), ("form", ""), ("div", "share"), ("div", "notice"), ("figure", "promo"), ("section", "comments"), ("div", "sidebar"), ("nav", "toc"), ("div", "related"), ("footer", ""), ("div", "newsletter")]
SAYINGS = {
    "notice": "We use cookies. Read our privacy policy and accept.", "form": "Subscribe to our newsletter", "share": "Share this page",
    "footer": "Copyright © All rights reserved. Terms and privacy", "comments": "Reply to this comment", "related": "Related stories",
}


def laid_out(found: list[Block], others: list[str], rng: random.Random) -> str:
    """A new page around the main blocks of ``found``; ``others`` lends sentences to its other parts."""
    escape = entities.escape
    some = lambda: " ".join(rng.choice(others).split()[: rng.choice((3, 6, 12, 25, 60))])

    def part(kinds: list[tuple[str, str]]) -> str:
        tag, names = rng.choice(kinds)
        say = next((s for k, s in SAYINGS.items() if k in f"{tag} {names}"), "")
        if tag in ("nav", "ul", "ol", "header") or "menu" in names or "related" in names:
            inside = "".join(f"<li><a href='#'>{escape(' '.join(some().split()[:3]))}</a></li>" for _ in range(rng.randrange(2, 7)))
        elif "comment" in names:
            inside = "".join(f"<div class='comment'><b>{escape(some()[:12])}</b><p>{escape(some())}</p></div>" for _ in range(rng.randrange(1, 5)))
        else:
            inside = "".join(f"<p>{escape(some())}</p>" if rng.random() < 0.5 else escape(some()) for _ in range(rng.randrange(1, 3)))
        if say and rng.random() < 0.6:
            inside = f"<p>{say}</p>{inside}"
        return f"<{tag}{f' {rng.choice(("class", "id"))}=\"{names}\"' if names else ''}>{inside}</{tag}>"

    def many(kinds: list[tuple[str, str]], most: int) -> str:
        return "".join(part(kinds) for _ in range(rng.randrange(most + 1)))

    tag, names = rng.choice(MAIN)
    body = []
    for b in found:
        kind = b.tag if b.tag in ("h1", "h2", "h3", "li", "blockquote") else "p"
        body.append(f"<{kind} {MARK}>{escape(b.text)}</{kind}>" if rng.random() < 0.9 else f"<div {MARK}>{escape(b.text)}</div>")
        if rng.random() < 0.1:
            body.append(part(WITHIN))
    main = f"<{tag}{f' class=\"{names}\"' if names else ''}>{''.join(body)}</{tag}>"
    return f"<html><body>{many(BEFORE, 3)}{main}{many(AFTER, 4)}</body></html>"


def labelled(pages: list[str], layouts: int = LAYOUTS) -> list[list[Block]]:
    """Labelled pages from stored ones: each as it is, and in new layouts."""
    rng = random.Random(11)
    found = [own_labels(blocks(p)) for p in pages]
    found = [f for f in found if any(b.label for b in f)]
    others = [b.text for f in found for b in f] or ["-"]
    made = [blocks(laid_out([b for b in f if b.label], others, rng)) for f in found for _ in range(layouts)]
    return [f for f in found + made if len(f) <= SAMPLE_BLOCKS]


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted on a bounded sample of ``pages`` (page_id, html). Without any labelled page it has no weights, and nothing is main text."""
    small = pages.where(F.length("html").between(1, chars)).select("page_id", "html", F.lit(0).alias("_all"))
    rows = bounded_sample(small, "_all", "page_id", sample).select("page_id", "html").collect()
    return fit_field(labelled([r["html"] for r in sorted(rows)]))


class Extractor:
    """Reads the main text of pages."""

    def __init__(self, model: Field):
        self.model = model

    def weight(self, above: Above) -> float:
        """The weights of the ancestors' features, worked out once for each element that adds some."""
        chain = []
        while above is not None and above.weight is None:
            chain.append(above)
            above = above.around
        total = above.weight if above is not None else 0.0
        for node in reversed(chain):
            total += sum(self.model.weights.get(f, 0.0) for f in node.names)
            node.weight = total
        return total

    def labels(self, found: list[Block]) -> list[int]:
        get = self.model.weights.get
        return viterbi([self.weight(b.above) + sum(get(f, 0.0) for f in own) for b, own in zip(found, features(found), strict=True)], self.model)

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, keep in zip(found, self.labels(found), strict=True) if keep)


def main_text(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the blocks that are main text, in page order, joined by an empty line.

    Character references are decoded; white space inside a block is one space. A null or empty html, and one without main text, give an empty
    text. Broken markup is read as far as it goes. Repeated rows repeat, null ids and urls are carried, other columns are
    ignored, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Extractor(model)
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [reader.text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
