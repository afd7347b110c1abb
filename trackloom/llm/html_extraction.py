"""Main text of web pages: content marginals on the DOM tree by sum-product message passing.

A page becomes a tree of its block elements, each with its own runs of text. Every node has a hidden label, content or
not. A potential of the node looks at its tag, at the words of its class, id and role, and at how long, how linked and how
punctuated its own text is; a potential between parent and child says how labels go on or change, by what the child is
marked as. One pass of messages from the leaves to the root and one back give every node's probability of being content;
all trees of a slice are passed at once, a depth at a time. Runs of nodes with a half or more are the text.

Weights maximise the likelihood of labelled pages. Where no labels are given, pages with an ``article`` or ``main`` label
themselves: what lies in it and is not marked as something else is content. So that the model also reads pages that are
marked in other ways or not at all, each labelled tree is repeated with its marks replaced, taken away or put on further
blocks (sidebars, notices, comments, forms) made of its own nodes.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.arrow_text import byte_slices, strings

SLICE_BYTES = 2 << 20
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>?""", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Kinds of elements, and words that name a part of a page.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "template"}
BLOCKS = {
    *("html", "head", "body", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "section"),
    *("article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "menu", "center", "hgroup"),
    *("select", "option", "optgroup", "button", "label", "legend", "noscript", "svg", "math", "object", "video", "audio", "canvas", "search"),
}
#: An opening tag that ends open ones, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table", "tr"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select"})),
    "body": ({"head"}, {"html"}),
}
INSIDE_P = {"button", "label", "select", "option", "optgroup", "noscript", "svg", "math", "object", "video", "audio", "canvas"}
TAGS = [
    *({"article", "main"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "legend", "select", "option", "optgroup", "button", "label", "search"}),
    *({"noscript", "svg", "object", "video", "audio", "canvas", "dialog"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}),
    *({"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"figure", "figcaption"}, {"address"}, {"div", "section", "center", "details", "summary", "math"}, {"html", "body", "head"}),
]
PARTS = {
    "content": "article content contents main body entry post story text prose hentry articlebody maincontent blogpost",
    "nav": "nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination toc tabs skip sitemap",
    "header": "header head masthead topbar logo branding titlebar hero",
    "footer": "footer foot copyright colophon legal contentinfo bottom imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular complementary more teaser",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay paywall subscribe subscription newsletter warning dialog message",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion outbrain taboola dfp",
    "form": "form search login signin signup register contact input poll survey",
    "comment": "comment comments disqus reply replies respond discussion review reviews thread feedback guestbook reader",
    "share": "share sharing social follow like likes meta byline author tags date timestamp toolbar tools print rating",
}
PART_OF = {word: i for i, words in enumerate(PARTS.values()) for word in words.split()}
NOISE_PARTS, CONTENT_PART = range(1, len(PARTS)), 0
NOISE_TAGS = range(1, 7)
TAG_OF = {tag: i for i, tags in enumerate(TAGS) for tag in tags}
LENGTHS = (1, 6, 16, 41)
N_FEATURES = len(TAGS) + len(PARTS) + len(LENGTHS) + 1 + 5
PLAIN, OTHER, CONTENT = range(3)


class Page:
    """The nodes of a page in order, and its runs of text."""

    __slots__ = ("parent", "depth", "tag", "parts", "hidden", "words", "linked", "stops", "runs")

    def __init__(self):
        self.parent, self.depth, self.tag, self.parts, self.hidden, self.words, self.linked, self.stops = [], [], [], [], [], [], [], []
        self.runs: list[tuple[int, str]] = []

    def add(self, parent: int, tag: int, parts: int, hidden: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.parts.append(parts)
        self.hidden.append(hidden)
        self.words.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.parent) - 1


MARKS: dict[str, tuple[int, bool]] = {}


def marks(attributes: str) -> tuple[int, bool]:
    """The parts that class, id and role name, as bits, and whether the element is hidden."""
    if attributes not in MARKS:
        if len(MARKS) > 50_000:
            MARKS.clear()
        bits = 0
        for m in NAMED.finditer(attributes):
            for word in WORDS.findall(m[2] or m[3] or m[4] or ""):
                if (part := PART_OF.get(word.lower())) is not None:
                    bits |= 1 << part
        MARKS[attributes] = bits, bool(HIDDEN.search(attributes))
    return MARKS[attributes]


def parsed(source: str) -> Page:
    """``source`` as nodes and runs. Unclosed, crossed and missing tags are taken as browsers do, near enough for text."""
    page = Page()
    root = page.add(-1, TAG_OF["html"], 0, False)
    stack, opened, held = [("html", root)], Counter(), []
    linked = 0  # depth of the stack where a link began, 0 outside links
    link_words = 0

    def flush():
        nonlocal held, link_words
        if held:
            text = " ".join("".join(held).split())
            if text:
                node = stack[-1][1]
                page.runs.append((node, text))
                page.words[node] += text.count(" ") + 1
                page.linked[node] += link_words
                page.stops[node] += text[-1] in ".!?…。:\"'”»)"
        held, link_words = [], 0

    def say(raw: str):
        nonlocal link_words
        text = entities.unescape(raw) if "&" in raw else raw
        held.append(text)
        if linked:
            link_words += len(text.split())

    def close():
        nonlocal linked
        flush()
        tag, _ = stack.pop()
        opened[tag] -= 1
        if linked > len(stack):
            linked = 0

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                linked = 0
            elif tag == "br":
                held.append(" ")
            elif opened[tag] and tag not in ("html", "body"):
                while stack[-1][0] != tag:
                    close()
                close()
        elif tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = found.end() if found else end
        elif tag == "a":
            linked = len(stack)
        elif tag == "br":
            held.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            if opened["p"] and tag not in INSIDE_P:
                while opened["p"]:
                    close()
            if tag in ENDS:
                gone, bound = ENDS[tag]
                if any(opened[x] for x in gone):
                    depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in bound or stack[i][0] in gone), 0)
                    if stack[depth][0] in gone:
                        while len(stack) > depth:
                            close()
            bits, hidden = marks(m[3]) if m[3] else (0, False)
            if tag == "html":
                continue
            node = page.add(stack[-1][1], TAG_OF[tag], bits, hidden)
            stack.append((tag, node))
            opened[tag] += 1
    flush()
    return page


def matrix(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of each node, and what kind of child it is."""
    n = len(page.parent)
    tag, parts = np.array(page.tag), np.array(page.parts)
    words, linked, stops = np.array(page.words), np.array(page.linked), np.array(page.stops)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[np.arange(n), tag] = 1
    a = len(TAGS)
    for i in range(len(PARTS)):
        x[:, a + i] = parts >> i & 1
    a += len(PARTS)
    x[np.arange(n), a + np.searchsorted(LENGTHS, words, side="right")] = 1
    a += len(LENGTHS) + 1
    x[:, a] = page.hidden
    x[:, a + 1] = linked * 2 > words
    x[:, a + 2] = (linked * 10 > words) & (linked * 2 <= words)
    x[:, a + 3] = (stops > 0) & (words >= 6)
    x[:, a + 4] = 1
    noise = np.isin(tag, NOISE_TAGS) | (parts >> 1 > 0) | np.array(page.hidden)
    kind = np.where(noise, OTHER, np.where((tag == 0) | (parts & 1 > 0), CONTENT, PLAIN))
    return x, kind


class Forest:
    """Trees end to end: features, kinds, parents, and nodes of each depth."""

    def __init__(self, pages: list[Page]):
        both = [matrix(p) for p in pages]
        self.x, self.kind = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
        self.start = np.cumsum([0, *(len(p.parent) for p in pages)])
        parent = [np.array(p.parent) + s for p, s in zip(pages, self.start, strict=False)]
        depth = np.concatenate([np.array(p.depth) for p in pages])
        self.parent = np.concatenate(parent)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.below = np.flatnonzero(depth > 0)

    def infer(self, w: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of content for each node, and of both labels for each (parent, child) of ``below``."""
        n = len(self.kind)
        up, at_parent = np.zeros((n, 2)), np.zeros((n, 2))
        up[:, 1] = self.x @ w
        for nodes in self.levels[:0:-1]:
            both = up[nodes, None, :] + e[self.kind[nodes]]
            at_parent[nodes] = np.logaddexp(both[..., 0], both[..., 1])
            np.add.at(up, self.parent[nodes], at_parent[nodes])
        total = up.copy()
        for nodes in self.levels[1:]:
            rest = total[self.parent[nodes]] - at_parent[nodes]
            both = rest[:, :, None] + e[self.kind[nodes]]
            total[nodes] += np.logaddexp(both[:, 0], both[:, 1])
        p = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))
        child = self.below
        pair = (total[self.parent[child]] - at_parent[child])[:, :, None] + e[self.kind[child]] + up[child, None, :]
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        return p, pair / pair.sum((1, 2), keepdims=True)


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Weights before any page is seen: marks mean what they say, labels go on from parent to child."""
    w, e = np.zeros(N_FEATURES), np.zeros((3, 2, 2))
    w[0], w[list(NOISE_TAGS)] = 2, -2
    w[len(TAGS)], w[[len(TAGS) + i for i in NOISE_PARTS]] = 1, -2
    a = len(TAGS) + len(PARTS)
    w[a + 3 : a + 5] = 1, 1.5
    w[a + 5], w[a + 6], w[a + 9] = -2, -1, -1
    e[PLAIN, 0, 0] = e[PLAIN, 1, 1] = 1.5
    e[CONTENT, 1, 1], e[OTHER, 0, 0] = 1, 1
    return w, e


class Model:
    def __init__(self, w: np.ndarray | None = None, e: np.ndarray | None = None):
        first = prior()
        self.w, self.e = first[0] if w is None else w, first[1] if e is None else e

    def texts(self, sources: list[str]) -> list[str]:
        """The main text of each page: runs of content nodes, joined by newlines."""
        pages = [parsed(s) for s in sources]
        forest = Forest(pages)
        good = forest.infer(self.w, self.e)[0] >= 0.5
        return ["\n".join(text for node, text in p.runs if good[s + node]) for p, s in zip(pages, forest.start, strict=False)]


def fit(pages: list[Page], labels: list[np.ndarray], rounds: int = 200, rate: float = 0.1, keep: float = 0.0001) -> Model:
    """Maximum likelihood by gradient steps (Adam), held to the prior by ``keep`` for each node."""
    if not pages:
        return Model()
    forest, y = Forest(pages), np.concatenate(labels).astype(int)
    child, kind = forest.below, forest.kind[forest.below]
    seen = np.zeros((3, 2, 2))
    np.add.at(seen, (kind, y[forest.parent[child]], y[child]), 1)
    first = np.concatenate([x.ravel() for x in prior()])
    theta, m, v, n = first.copy(), 0.0, 0.0, len(y)
    for t in range(1, rounds + 1):
        p, pair = forest.infer(theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2))
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, kind, pair)
        grad = np.concatenate([forest.x.T @ (y - p), (seen - expected).ravel()]) / n - keep * (theta - first)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(3, 2, 2))


def noisy(page: Page, node: int) -> bool:
    return page.tag[node] in NOISE_TAGS or page.parts[node] >> 1 > 0 or page.hidden[node]


def by_markup(page: Page) -> np.ndarray | None:
    """Labels from the page's own ``article`` or ``main``, without what is marked as another part inside; None without."""
    if 0 not in page.tag:
        return None
    y = np.zeros(len(page.parent), bool)
    for node, parent in enumerate(page.parent):
        y[node] = parent >= 0 and not noisy(page, node) and (page.tag[node] == 0 or y[parent])
    return y if any(y[node] for node, _ in page.runs) else None


def by_text(page: Page, text: str) -> np.ndarray:
    """Labels from the known main text: nodes that hold one of its lines, and nodes whose children's texts all do."""
    lines = set(text.split("\n"))
    held, good = np.zeros(len(page.parent), int), np.zeros(len(page.parent), int)
    for node, run in page.runs:
        held[node] += 1
        good[node] += run in lines
    for node in range(len(page.parent) - 1, 0, -1):
        held[page.parent[node]] += held[node]
        good[page.parent[node]] += good[node]
    return (held > 0) & (held == good)


def copied(page: Page, top: int, into: Page, under: int, unmarked: bool, y: list) -> None:
    """The nodes of ``page`` from ``top`` down put below ``under`` as no content; ``unmarked``: the first one without its marks."""
    place = {top: into.add(under, *((TAG_OF["div"], 0) if unmarked else (page.tag[top], page.parts[top])), False)}
    y.append(False)
    for node in range(top + 1, len(page.parent)):
        if page.depth[node] <= page.depth[top]:
            break
        place[node] = into.add(place[page.parent[node]], page.tag[node], page.parts[node], page.hidden[node])
        y.append(False)
    for node, at in place.items():
        into.words[at], into.linked[at], into.stops[at] = page.words[node], page.linked[node], page.stops[node]


def variant(page: Page, y: np.ndarray, rng: random.Random) -> tuple[Page, np.ndarray]:
    """The labelled tree with its parts marked otherwise and with further parts made of its own nodes, or all bare."""
    out, labels, bare = Page(), [], rng.random() < 0.25
    plain, named = TAG_OF["div"], {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    out.add(-1, page.tag[0], page.parts[0], page.hidden[0])
    labels.append(bool(y[0]))
    place, tops = {0: 0}, []
    for node in range(1, len(page.parent)):
        parent, tag, parts = page.parent[node], page.tag[node], page.parts[node]
        if bare and (parent not in place or noisy(page, node)):
            continue
        if y[node] and not y[parent]:
            tops.append(node)
            tag, parts = (plain, 0) if bare else rng.choice([(tag, parts), (plain, 1 << CONTENT_PART), (plain, 1 << CONTENT_PART), (plain, 0)])
        elif noisy(page, node) and not noisy(page, parent):
            kinds = [i for i in NOISE_PARTS if parts >> i & 1] or [named.get(tag, 1)]
            tag, parts = rng.choice([(tag, parts), (plain, 1 << rng.choice(kinds)), (plain, 1 << rng.choice(kinds) | (1 << CONTENT_PART) * (rng.random() < 0.2))])
        place[node] = at = out.add(place[parent], tag, parts, page.hidden[node])
        out.words[at], out.linked[at], out.stops[at] = page.words[node], page.linked[node], page.stops[node]
        labels.append(bool(y[node]))
    inner = [n for n, p in enumerate(page.parent) if p >= 0 and y[n] and y[p]]
    noise = [n for n, p in enumerate(page.parent) if p >= 0 and noisy(page, n) and not noisy(page, p)]
    for _ in range(0 if bare else rng.randrange(1, 5)):
        under = place[rng.choice(tops)] if tops and rng.random() < 0.4 else place[page.parent[tops[0]]] if tops else 0
        part = rng.choice(list(NOISE_PARTS))
        tag = rng.choice([plain, plain, *NOISE_TAGS])
        box = out.add(under, tag, 1 << part if tag == plain or rng.random() < 0.5 else 0, False)
        labels.append(False)
        for top in rng.sample(inner, min(len(inner), rng.randrange(0, 4))) or rng.sample(noise, min(len(noise), 1)):
            copied(page, top, out, box, top not in inner, labels)
    return out, np.array(labels)


def train(labelled: list[tuple[str, str | None]], variants: int = 3, seed: int = 1) -> Model:
    """A model from pages (html, main text); where the text is None, from the page's own markup, if it has any."""
    rng, pages, labels = random.Random(seed), [], []
    for source, text in labelled:
        page = parsed(source or "")
        y = by_markup(page) if text is None else by_text(page, text)
        if y is not None:
            for got in [(page, y), *(variant(page, y, rng) for _ in range(variants))]:
                pages.append(got[0])
                labels.append(got[1])
    return fit(pages, labels)


def sampled(pages: DataFrame, n: int, longest: int) -> list[tuple[str, None]]:
    """Of the ``n`` pages with the least hashes of id and address those of at most ``longest`` characters, for :func:`train`.

    Hashes are compared first, so that a task sends ``n`` numbers and the driver gets ``n`` pages, however many there are.
    """
    rows = pages.select("html", F.xxhash64("page_id", "url").alias("h"))
    least = [r.h for r in rows.select("h").orderBy("h").limit(n).collect()]
    if not least:
        return []
    some = rows.where((F.col("h") <= least[-1]) & (F.length("html") <= longest)).limit(n).collect()
    return [(r.html, None) for r in sorted(some, key=lambda r: (r.h, r.html))]


def main_text(pages: DataFrame, model: Model | None = None, labelled: int = 200, longest: int = 50_000) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    White space inside a run, after character references, is one space; runs are joined by newlines. A null or empty
    page has the text ``""``, as has one without content. Repeated rows stay; further columns are not read; an empty
    table gives an empty result. ``model``: fitted on a bounded sample of ``labelled`` pages of at most ``longest``
    characters if none is given. Its few hundred numbers go along with the task.
    """
    model = model or train(sampled(pages, labelled, longest))
    w, e = model.w, model.e
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(w, e)
        for batch in batches:
            sources = strings(batch.column("html"))
            for a, b in byte_slices(sources, SLICE_BYTES):
                texts = own.texts(sources.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
