"""Main-text extraction from HTML by minimum-cut labelling of text blocks.

A page is scanned into blocks: runs of text between block-level tags, with their ancestors. Scripts, styles and other
elements that are never text are left out by the scan, which is linear in the page, however its tags and quotes fail to
match. A logistic classifier gives each block costs of being content or boilerplate; these are the terminal capacities. Its
weights on a block's own text (length, share of links, kind of element, end of a sentence) are fitted on a sample of pages
that name their article, and apply to those that don't; what tags and class names say is added. Neighbouring blocks, and
blocks with the same parent or section, are joined by smoothness edges whose capacity falls with their distance in the
DOM. Maximum flow separates the two sides; the text is what stays with the content.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, with_fields

#: Fixed values from the HTML standard: elements without text for readers, void elements, elements that break a line.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title textarea select option datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q ruby rb rp rt rtc s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Start tags before which an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: Words of class, id and role that tell what a section is.
CONTENT_WORDS = frozenset("article post content entry story body main text articlebody".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended recommendations share sharing social cookie cookies consent "
    "notice notices gdpr popup modal overlay newsletter subscribe subscription signup login form search comment comments respond reply replies "
    "disqus discussion reader copyright legal disclaimer toolbar pager pagination skip hidden complementary contentinfo alert teaser".split()
)
BOILER_TAGS = frozenset("nav header footer aside form button dialog menu search fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words that say where or how large an element is; a class of these and boilerplate words alone names boilerplate.
PLACE_WORDS = frozenset(
    "area bar block bottom box button buttons col column container content global group holder inner item items left links list logo lower "
    "mid middle module outer page panel primary region right row secondary section site slot small spot top unit upper wrap wrapper zone".split()
)
#: Classes that begin so describe a layout, not the element's own text.
LAYOUT_PREFIXES = ("has-", "with-", "no-", "layout-", "js-")
#: Log odds for content that names add: of an element or its ancestors.
W_CONTENT_TAG, W_CONTENT_WORD, W_BOILER_TAG, W_BOILER_WORD, W_HIDDEN = 3.0, 1.5, -5.0, -5.0, -20.0
#: Log odds for content by a block's own text where no page names its article, in the order of features().
TEXT_WEIGHTS = (0.2, -3.0, 0.35, 0.8, 0.2, 0.4)
#: Capacity of the edge between neighbours in the same element; it halves with each two steps of DOM distance, to REACH.
SMOOTH, REACH = 2.0, 16
#: The sample that weights are fitted on: pages, characters of a page, and how far a fitted weight stays from the one above.
SAMPLE_PAGES, SAMPLE_CHARS, RIDGE = 400, 100_000, 2.0

#: Quotes count behind an equals sign only, and only in pairs; possessive, so that no text is looked at twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^=>]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMING = frozenset("class id role aria-label hidden style".split())
_NONE = re.compile(r"display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
#: Elements whose content is not markup.
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
#: Elements of a list or table that end an open one of these, and the elements that they don't reach beyond.
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_LISTS = ("ul", "ol", "dl", "table")
#: Elements inside a paragraph that shield it from a start tag that would end it.
_SHIELDS = ("div", "section", "article", "td", "li", "button")


@dataclass(eq=False)
class Node:
    """An open element: what it and its ancestors say, and the nearest element around or at it that breaks a line."""

    tag: str
    parent: Node | None = None
    marks: frozenset[str] = frozenset()
    depth: int = 0
    owner: Node = field(init=False)

    def __post_init__(self):
        inline = self.parent is not None and self.tag in INLINE
        self.owner = self.parent.owner if inline else self
        if self.parent is not None:
            self.marks = self.marks | self.parent.marks if self.marks else self.parent.marks
            self.depth = self.parent.depth + (not inline)


@dataclass
class Block:
    """A run of text: its decoded text with single spaces, the element that it is in, and how much of it is links."""

    text: str
    owner: Node
    links: int
    marks: frozenset[str]

    @property
    def tag(self) -> str:
        return self.owner.tag


def _names_boilerplate(name: str) -> bool:
    """Whether a class, id or role is made of boilerplate words and words of place alone: 'social' but not 'social-history'."""
    words = {w.lower() for w in _NAME.findall(name)}
    return bool(words & BOILER_WORDS) and words <= BOILER_WORDS | PLACE_WORDS | CONTENT_WORDS


def _marks(tag: str, rest: str) -> frozenset[str]:
    """What an element says about its text: 'content', 'content-tag', 'boiler', 'boiler-tag', 'hidden'."""
    if tag in ("html", "body"):
        return frozenset()
    out = {"content-tag"} if tag in CONTENT_TAGS else {"boiler-tag"} if tag in BOILER_TAGS else set()
    for name, a, b, c in _ATTR.findall(rest) if rest else ():
        name, value = name.lower(), a or b or c
        if name not in _NAMING:
            continue
        if name == "hidden" or (name == "style" and _NONE.search(value)):
            out.add("hidden")
        elif name != "style":
            named = [w for w in value.split() if not w.lower().startswith(LAYOUT_PREFIXES)]
            if any(map(_names_boilerplate, named)):
                out.add("boiler")
            elif CONTENT_WORDS & {w.lower() for token in named for w in _NAME.findall(token)}:
                out.add("content")
    return frozenset(out)


class _Open:
    """The open elements, with the places of each kind at hand: no step walks down the stack."""

    def __init__(self):
        self.stack = [Node("")]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.breaking = [0]  # places of elements that break a line

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def push(self, tag: str, marks: frozenset[str]) -> None:
        self.places[tag].append(len(self.stack))
        if tag not in INLINE:
            self.breaking.append(len(self.stack))
        self.stack.append(Node(tag, self.stack[-1], marks))

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.breaking.pop()


def blocks(page: str) -> list[Block]:
    """The text blocks in page order. Unclosed and wrongly nested tags close as they do in browsers, roughly."""
    open_, out = _Open(), []
    parts: list[tuple[str, bool]] = []
    ends: dict[str, dict[int, int]] = {}
    n, at = len(page), 0

    def flush():
        if not parts:
            return
        text = _SPACE.sub(" ", "".join([t for t, _ in parts])).strip()
        if text:
            inner = open_.stack[-1]
            out.append(Block(text, inner.owner, sum(len(t.strip()) for t, link in parts if link), inner.marks))
        parts.clear()

    def close(k: int):
        if open_.breaking[-1] >= k:
            flush()
        open_.cut(k)

    def add(raw: str):
        if raw:
            parts.append((html.unescape(raw), bool(open_.places["a"])))

    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        m = _MARKUP.match(page, start)
        if m is None:
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = m.end()
        if not m["tag"]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "p" or tag == "br":
                flush()
            k = open_.last(tag)
            # An inline end tag does not reach beyond the block that it stands in.
            if k and not (tag in INLINE and open_.breaking[-1] > k):
                close(k)
            continue
        if tag in SKIPPED:
            flush()
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
            elif not m["rest"].rstrip().endswith("/"):
                if tag not in ends:
                    ends[tag] = _matching(page, tag)
                # Without an end tag the element holds nothing, so that the rest of the page is not lost.
                at = max(at, ends[tag].get(start, at))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append((" ", False)) if tag == "br" else flush()
            continue
        if tag in ENDS_P and (k := open_.last("p")) and open_.last(*_SHIELDS) < k:
            close(k)
        if tag in _SIBLINGS:
            while (k := open_.last(*_SIBLINGS[tag])) > open_.last(*_LISTS):
                close(k)
                if tag != "tr":
                    break
        if tag not in INLINE:
            flush()
        open_.push(tag, _marks(tag, m["rest"]))
    flush()
    return out


def _matching(page: str, tag: str) -> dict[int, int]:
    """The place of each start tag of this kind that has an end tag -> the place behind it."""
    out: dict[int, int] = {}
    waiting: list[int] = []
    for m in re.compile(rf"<(/?){tag}\b[^<>]*>", re.I).finditer(page):
        if not m[1]:
            if not m[0].endswith("/>"):
                waiting.append(m.start())
        elif waiting:
            out[waiting.pop()] = m.end()
    return out


def features(b: Block) -> tuple[float, ...]:
    """What the classifier sees of a block's own text: 1, share of links, length, paragraph, heading, end of a sentence."""
    n = len(b.text)
    kind = b.tag in ("p", "blockquote", "pre"), b.tag in ("h1", "h2", "h3", "h4")
    return 1.0, min(1.0, b.links / n), math.log1p(n / 20), float(kind[0]), float(kind[1]), float(b.text[-1] in ".!?…。！？\"”")


def log_odds(b: Block, weights: tuple[float, ...] = TEXT_WEIGHTS) -> float:
    """The classifier: log odds that a block is content."""
    z = sum(w * x for w, x in zip(weights, features(b), strict=True))
    z += W_CONTENT_TAG * ("content-tag" in b.marks) + W_CONTENT_WORD * ("content" in b.marks)
    z += W_BOILER_TAG * ("boiler-tag" in b.marks) + W_BOILER_WORD * ("boiler" in b.marks)
    return z + W_HIDDEN * ("hidden" in b.marks)


def fit(pages: list[str]) -> tuple[float, ...]:
    """Weights of features() fitted on the pages that name an article: its blocks are content, all others boilerplate.

    Every page counts the same. A ridge around TEXT_WEIGHTS stands for what these pages don't show; without such pages
    TEXT_WEIGHTS is the result.
    """
    x, y, own = [], [], []
    for page in pages:
        found = [b for b in blocks(page) if "hidden" not in b.marks]
        inside = ["content-tag" in b.marks and not b.marks & {"boiler", "boiler-tag"} for b in found]
        if any(inside) and not all(inside):
            x += map(features, found)
            y += inside
            own += [1 / len(found)] * len(found)
    base = np.array(TEXT_WEIGHTS)
    if not x:
        return TEXT_WEIGHTS
    features_, label_, weight = np.array(x), np.array(y, float), np.array(own)
    w = base.copy()
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(features_ @ w, -30, 30)))
        grad = features_.T @ (weight * (p - label_)) + RIDGE * (w - base)
        bend = (features_ * (weight * p * (1 - p))[:, None]).T @ features_ + RIDGE * np.eye(len(w))
        w = w - np.linalg.solve(bend, grad)
    return tuple(w.tolist())


def _distance(a: Node, b: Node) -> int:
    """Steps in the DOM between two elements that break a line; REACH stands for all from there on."""
    steps = 0
    while a is not b and steps < REACH:
        if a.depth >= b.depth:
            a = a.parent.owner if a.parent else a
        else:
            b = b.parent.owner if b.parent else b
        steps += 1
    return steps


class Flow:
    """Maximum flow by shortest augmenting paths in level graphs; nodes n and n + 1 are source and sink."""

    def __init__(self, n: int):
        self.n = n + 2
        self.to: list[int] = []
        self.cap: list[float] = []
        self.edges: list[list[int]] = [[] for _ in range(self.n)]

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def levels(self, source: int) -> list[int]:
        level = [-1] * self.n
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.cap[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """The nodes on the source's side of a minimum cut."""
        while (level := self.levels(source))[sink] >= 0:
            nth = [0] * self.n
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    least = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= least
                        self.cap[e ^ 1] += least
                    k = next(i for i, e in enumerate(path) if self.cap[e] <= 1e-9)
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                edges = self.edges[x]
                while nth[x] < len(edges):
                    e = edges[nth[x]]
                    if self.cap[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                        break
                    nth[x] += 1
                else:
                    if x == source:
                        break
                    x = self.to[path.pop() ^ 1]
                    nth[x] += 1
                    continue
                path.append(e)
                x = self.to[e]
        return [l >= 0 for l in level]


def label(found: list[Block], weights: tuple[float, ...] = TEXT_WEIGHTS) -> list[bool]:
    """Whether each block is content: the source's side of the minimum cut."""
    n = len(found)
    if not n:
        return []
    flow = Flow(n)
    source, sink = n, n + 1
    for i, b in enumerate(found):
        z = max(min(log_odds(b, weights), 30), -30)
        # Costs are negative log likelihoods: cutting from the source means boilerplate, from the sink content.
        flow.join(source, i, math.log1p(math.exp(z)))
        flow.join(i, sink, math.log1p(math.exp(-z)))
    last: dict[Node, int] = {}
    for i, b in enumerate(found):
        if i and (steps := _distance(found[i - 1].owner, b.owner)) < REACH:
            w = SMOOTH * 0.5 ** (steps / 2)
            flow.join(i - 1, i, w, w)
        # The previous block of the same section, if it is not the neighbour.
        section: Node | None = b.owner
        for _ in range(3):
            if section is None or section.parent is None:
                break
            if (k := last.get(section)) is not None and k < i - 1:
                w = SMOOTH / 2 * 0.5 ** (_distance(found[k].owner, b.owner) / 2)
                flow.join(k, i, w, w)
            last[section] = i
            section = section.parent.owner
    return flow.source_side(source, sink)[:n]


def extract(page: str | None, weights: tuple[float, ...] = TEXT_WEIGHTS) -> str:
    """The main text of a page: content blocks in page order, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def train(pages: DataFrame, html_column: str = "html", most: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> tuple[float, ...]:
    """Weights fitted on about `most` pages, and 2 `most` at the very most, of up to `chars` characters, by a hash of the page."""
    x = F.col(html_column)
    fit_ = pages.where(F.length(x).between(1, chars)).select(x.alias("html"), F.xxhash64(x).alias("h"))
    n = fit_.count()
    if not n:
        return TEXT_WEIGHTS
    chosen = fit_.where(F.pmod("h", F.lit(1_000_000)) < 1_000_000 * min(1.0, most / n))
    # Repeated pages are one; ordered, so that the sample is the same in every run.
    rows = chosen.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(2 * most).collect()
    return fit([r["html"] for r in rows])


def main_text(pages: DataFrame, html_column: str = "html", weights: tuple[float, ...] = TEXT_WEIGHTS) -> DataFrame:
    """pages with text string and n_chars long.

    The whole html is scanned, however long; null and empty html, and pages without content, give an empty text. Where a
    block's two costs tie it is boilerplate. Repeated rows get equal answers, an empty table gives an empty one; columns
    named text or n_chars are replaced, others returned as they are.
    """
    pages = pages.drop("text", "n_chars")

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(batch.schema.names.index(html_column))]
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, with_fields(pages.schema, "text string, n_chars long"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, weights=train(pages)).select("page_id", "url", "text", "n_chars")
