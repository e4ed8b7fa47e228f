"""HTML extraction (operator 5): main text of pages by a minimum cut between content and boilerplate.

A page becomes a list of text blocks, each with what its place in the document
says: elements around it, their classes, the share of link text, its length. A
logistic classifier, fitted to pages of our own making (html_sample), turns that
into log-odds, which are the capacities of a block's edge to one of the two
terminals. Blocks that follow each other, and blocks that follow each other under
one parent, are tied by smoothness edges, the stronger the nearer they are in
the tree, and weaker where an element says that something else begins; their
strength is chosen on further such pages. The minimum cut is the cheapest
labelling, and blocks on its content side are the text.

Names of elements, classes and ids that say boilerplate or replies count the
less, the more of the page's text their element holds, so a wrapper named for
what stands beside the article (a search page, a form around a whole page) keeps
it. Compound names of states (has-sidebar, comments-open) say neither. Only text
that is never shown or belongs to a control (a button, a list of options) can't
be content whatever stands beside it.

Defined cases: a null or empty page has empty text; text that isn't closed goes
on to the page's end; scripts, styles and other raw text never make blocks;
unknown character references stay as written; white space of any kind, ``br``
included, is one space within a block. Pages are read whole, however long, each
in one task; repeated rows repeat their results; an empty table gives no rows;
columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import html_sample
from tidewell.llm.textvec import pieces
from tidewell.storage import bound_batches

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z>])[^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
#: Elements whose text isn't shown as text, or is a control's.
_HARD = frozenset("button dialog head noscript object select svg template canvas audio video".split())
#: Elements that say boilerplate, as do words of a class or id; the first never hold a whole page.
_BESIDE = frozenset("aside footer menu nav search".split())
_AROUND = frozenset("fieldset form".split())
_CLOSES_P = _BLOCK - frozenset("body button caption dd dt head html legend li noscript object optgroup option svg tbody td template tfoot th thead tr select".split())
#: What an opening tag closes first, and the elements that it doesn't look beyond.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}

#: Words in a class or id that say boilerplate, wherever the element is.
_BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor sponsors promo promos promotion cookie cookies consent gdpr newsletter "
    "subscribe subscription signup breadcrumb breadcrumbs pagination pager paging menu menus navbar nav navigation popup modal overlay lightbox share sharing social recommended recommendations sidebar "
    "footer widgets login toolbar skip donate paywall".split()
)
#: Words that make a compound name one of a state of the page, and not of what an element holds.
_STATES = frozenset("has have no not non with without is are enabled disabled enable disable open opened closed off on allowed available supported".split())
#: Words that say what readers wrote.
_REPLIES = frozenset("comment comments disqus respond responses reply replies".split())
#: Words that may say boilerplate or replies, or a part of an article.
_WEAK = frozenset("header masthead topbar banner notice notices alert alerts warning announcement byline tags copyright legal disclaimer rail secondary side meta author bio toc print hidden related search feedback poll survey discussion widget popular more".split())
_GOOD = frozenset("article content entry post story text body main prose".split())
_ROLES = {"navigation": 2, "banner": 1, "contentinfo": 2, "complementary": 2, "search": 2, "form": 2, "dialog": 2, "alert": 1, "alertdialog": 2, "menu": 2, "menubar": 2, "toolbar": 2}
_PHRASE = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bsign (?:up|in)\b|\blog ?in\b|\bread more\b|\bshare this\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\badvertisement\b", re.I)

#: Capacity of one unit of cost.
UNIT = 1000
#: Log-odds of text that isn't shown, and the most that a classifier gives.
HARD, MOST = -50.0, 9.0
#: A mark's weight is (1 - share ** power) ** EDGE, where share is how much of the page's text its element holds.
POWERS, EDGE = {"bad": 2, "replies": 3, "weak": 2}, 4


class Mark:
    """An element whose name, class, id or role says boilerplate or replies, and the marks around it."""

    __slots__ = ("above", "nth", "kinds", "box", "held", "whole", "inner")

    def __init__(self, above: Mark | None, nth: int, kinds: tuple, box: int):
        self.above, self.nth, self.kinds, self.box, self.held = above, nth, kinds, box, 0.0
        #: By kind, how far this mark and those above say nothing: all of them, and those within the box.
        self.whole = self.inner = dict.fromkeys(POWERS, 1.0)

    def weigh(self, total: float) -> None:
        share = min(self.held / total, 1.0) if total else 0.0
        own = {kind: 1.0 - (1.0 - share ** POWERS[kind]) ** EDGE if kind in self.kinds else 1.0 for kind in POWERS}
        up = self.above
        self.whole = {kind: own[kind] * (up.whole[kind] if up else 1.0) for kind in POWERS}
        self.inner = {kind: own[kind] * (up.inner[kind] if up and up.box == self.box else 1.0) for kind in POWERS}


class Block:
    __slots__ = ("text", "links", "tag", "parent", "depth", "state")

    def __init__(self, text: str, links: int, tag: str, parent: int, depth: int, state: tuple):
        self.text, self.links, self.tag, self.parent, self.depth, self.state = text, links, tag, parent, depth, state


def _marks(attributes: str, name: str) -> tuple[set[str], bool, bool]:
    """What words of class, id and role say: the kinds of marks, content, and whether the element is hidden."""
    kinds: set[str] = set()
    good = unseen = apart = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden":
            unseen = True
        elif key == "aria-hidden":
            unseen |= value.strip().lower() == "true" and name not in ("i", "span", "svg")
        elif key == "style":
            flat = value.replace(" ", "").lower()
            unseen |= "display:none" in flat or "visibility:hidden" in flat
        elif key == "role":
            level = _ROLES.get(value.strip().lower(), 0)
            kinds |= {"bad"} if level == 2 else {"weak"} if level == 1 else set()
            good |= value.strip().lower() in ("main", "article")
        elif key == "itemprop":
            good |= value.lower() in ("articlebody", "text")
        else:
            for word in value.split():
                found = {x.lower() for x in _PARTS.findall(word)}
                state = len(found) > 1 and not found.isdisjoint(_STATES)
                if not state:
                    kinds |= {kind for kind, words in (("bad", _BAD), ("replies", _REPLIES), ("weak", _WEAK)) if not found.isdisjoint(words)}
                fine = not found.isdisjoint(_GOOD)
                good |= fine
                apart |= fine and found.isdisjoint(_REPLIES)
    if "replies" in kinds and (apart or name in ("body", "html", "main")):  # an entry with comments, say
        kinds = kinds - {"replies"} | {"bad"}
    return kinds, good, unseen


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order.

    A block's state is (hard, beside, innermost mark, box, good, element that
    begins something else); its box is the innermost article or main element
    around it.
    """
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    blank = (False, False, None, 0, 0, 0)
    stack: list[tuple[str, int, tuple]] = [("", 0, blank)]  # name, number of the nearest block element, state
    numbers = links = marks = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                name, number, state = stack[-1]
                tag = next((x[0] for x in reversed(stack) if x[0] in _BLOCK), "")
                out.append(Block(whole, min(linked, len(whole)), tag, number, len(stack), state))
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = unescape(piece)
        text.append(piece)
        if links:
            linked += len(piece.strip())

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if name == "p" and not any(x[0] == "p" for x in stack):
                flush()
                continue
            if name in _BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if any(x[0] in _BLOCK for x in stack[i:]):
                        flush()
                    links -= sum(x[0] == "a" for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK and name not in _BLOCK:
                    break  # an end tag of inline markup doesn't close blocks
            continue
        if name in _RAW:
            close = _RAW[name].search(page, at)
            at = close.end() if close else end
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        block = name in _BLOCK
        if block:
            flush()
            closes, stop = _IMPLIED.get(name, ((), ()))
            upto = None
            for i in range(len(stack) - 1, 0, -1):
                inner = stack[i][0]
                if inner in stop or inner in ("table", "template") and name in _CLOSES_P:
                    break
                if inner in closes or inner == "p" and (name in _CLOSES_P or closes):
                    upto = i
                    if inner in closes:
                        break
            if upto is not None:
                links -= sum(x[0] == "a" for x in stack[upto:])
                del stack[upto:]
        elif name == "a" and links:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "a":
                    links -= 1
                    del stack[i]
                    break
        _, number, state = stack[-1]
        hard, beside, mark, box, good, shut = state
        if block or attributes:
            kinds, fine, unseen = _marks(attributes, name) if attributes and not attributes.isspace() and name not in ("html", "body") else (set(), False, False)
            if name == "header":
                kinds = kinds | {"weak"}
            if name in _AROUND:
                kinds = kinds | {"bad"}
            if kinds:
                marks += 1
                mark = Mark(mark, marks, tuple(kinds), box)
            if name in ("article", "main") or fine and not kinds and block and "role" in attributes:
                numbers += 1
                box = numbers
            good += fine
            hard |= name in _HARD or unseen
            beside |= name in _BESIDE
            if block:
                numbers += 1
                number = numbers
            if kinds or name in _HARD or name in _BESIDE or unseen:
                shut = numbers = numbers + 1
            state = (hard, beside, mark, box, good, shut)
        stack.append((name, number, state))
        links += name == "a"
    flush()
    return out


def features(block: Block, main: int, around: frozenset[int]) -> list[float]:
    """What the classifier knows of a block; ``main`` is the page's main box, 0 if it has none, ``around`` the marks that hold it."""
    _, beside, mark, box, good, _ = block.state
    own = box == main and main > 0
    n = block.text.count(" ") + 1
    left = dict.fromkeys(POWERS, 1.0) if mark is None else mark.whole
    if own and mark is not None:  # what lies around the main box says nothing of it
        left = {"replies": left["replies"]} | {kind: mark.inner[kind] if mark.box == box else 1.0 for kind in ("bad", "weak")}
    elif main:  # an element beside the main box is no wrapper of the article, however much it holds
        left = dict(left)
        while mark is not None and mark.nth not in around:
            left |= dict.fromkeys(mark.kinds, 0.0)
            mark = mark.above
    head = block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    weak = 1.0 - left["weak"]
    return [
        1.0, math.log1p(n), block.links / len(block.text), float(block.text[-1] in ".!?:;…\"'”»"),
        float(block.tag in ("p", "blockquote", "pre")), float(block.tag == "h1"), float(head and block.tag != "h1"), float(block.tag in ("li", "td", "th", "dt", "dd")),
        float(own), float(main > 0 and not box), float(main > 0 and box > 0 and not own), min(good, 2) / 2,
        float(beside), 1.0 - left["bad"], 1.0 - left["replies"], weak * head, weak * (not head), weak * math.log1p(n) * (not head) * own,
        float(n < 30 and _PHRASE.search(block.text) is not None),
    ]


def minimum_cut(gain: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source: gain is capacity to the source if positive, to the sink if negative."""
    n = len(gain)
    if not any(g > 0 for g in gain):
        return [False] * n
    if not any(g < 0 for g in gain):
        return [True] * n
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def edge(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, g in enumerate(gain):
        if g > 0:
            edge(source, v, g, 0)
        elif g < 0:
            edge(v, sink, -g, 0)
    for a, b, w in ties:
        edge(a, b, w, w)
    while True:  # Dinic's algorithm
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nth = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                cut = 0
                for i, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] == 0 and cut == 0:
                        cut = i + 1
                del path[cut - 1 :]
                v = to[path[-1]] if path else source
                continue
            while nth[v] < len(head[v]):
                e = head[v][nth[v]]
                if room[e] > 0 and level[to[e]] == level[v] + 1:
                    break
                nth[v] += 1
            else:
                if v == source:
                    break
                level[v] = -1
                e = path.pop()
                v = to[e ^ 1]
                continue
            path.append(head[v][nth[v]])
            v = to[path[-1]]


def _weigh(blocks: list[Block]) -> None:
    """Weigh all marks: by the page's text, then by what of it that leaves, so that many small replies don't make an article small."""
    seen: dict[int, Mark] = {}
    size = [0.0 if b.state[0] or b.state[1] else float(len(b.text) - b.links) for b in blocks]
    for b in blocks:
        mark = b.state[2]
        while mark is not None and mark.nth not in seen:
            seen[mark.nth] = mark
            mark = mark.above
    order = [seen[nth] for nth in sorted(seen)]
    for _ in range(2 if order else 0):
        for mark in order:
            mark.held = 0.0
        left = [n if b.state[2] is None else n * b.state[2].whole["bad"] * b.state[2].whole["replies"] for n, b in zip(size, blocks, strict=True)]
        for n, b in zip(left, blocks, strict=True):
            if b.state[2] is not None:
                b.state[2].held += n
        for mark in reversed(order):
            if mark.above is not None:
                mark.above.held += mark.held
        total = sum(left)
        for mark in order:
            mark.weigh(total)


def described(blocks: list[Block]) -> np.ndarray:
    """A row of features for every block of a page."""
    _weigh(blocks)
    held: dict[int, float] = {}
    whole: dict[int, float] = {}
    for b in blocks:
        hard, beside, mark, box, *_ = b.state
        if box and not hard and not beside:
            left = 1.0 if mark is None else mark.whole["replies"] * (mark.inner["bad"] if mark.box == box else 1.0)
            held[box] = held.get(box, 0.0) + left * (len(b.text) - b.links)
            whole[box] = whole.get(box, 0.0) + len(b.text)
    main = max(held, key=lambda x: (held[x], -x)) if held else 0
    if main and held[main] < whole[main] / 2:  # readers' comments, say: the article is elsewhere
        main = 0
    around: set[int] = set()
    for b in blocks:
        mark = b.state[2] if main and b.state[3] == main else None
        while mark is not None and mark.nth not in around:
            if mark.box != main:
                around.add(mark.nth)
            mark = mark.above
    return np.array([features(b, main, frozenset(around)) for b in blocks])


def ties(blocks: list[Block], strength: float, across: float) -> list[tuple[int, int, int]]:
    """Smoothness edges between blocks that follow each other on the page or under one parent."""
    out: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}

    def tie(a: int, i: int, near: float) -> None:
        same = 1.0 if blocks[a].state[5] == blocks[i].state[5] else across
        if same and strength:
            out.append((a, i, round(UNIT * strength * near * same)))

    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            tie(i - 1, i, 1.0 if a.parent == b.parent else 0.8 if a.depth == b.depth else 0.4)
        before = last.get(b.parent)
        if before is not None and before < i - 1:
            tie(before, i, 1.0)
        last[b.parent] = i
    return out


Model = tuple[tuple[float, ...], float, float]


def odds(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """Log-odds that each block is content."""
    found = np.clip(described(blocks) @ weights, -MOST, MOST)
    found[[b.state[0] for b in blocks]] = HARD
    return found


def cut(blocks: list[Block], found: np.ndarray, strength: float, across: float) -> list[bool]:
    return minimum_cut([round(UNIT * x) for x in found.tolist()], ties(blocks, strength, across))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _labelled(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    out = []
    for page in html_sample.pages(n, seed):
        blocks, right = blocks_of(page), []
        for b in blocks:
            b.text, good = html_sample.truth(b.text)
            right.append(good)
        out.append(([b for b in blocks if b.text], np.array([r for b, r in zip(blocks, right, strict=True) if b.text])))
    return out


@lru_cache(maxsize=1)
def fitted() -> Model:
    """Weights of the classifier, and the strength of ties within an element and across its border.

    The weights fit ``html_sample.PAGES`` pages; the ties are those with which
    the cut labels ``CHOOSING`` other pages best, the weakest where several do.
    """
    known = _labelled(html_sample.PAGES, 1)
    weights = logistic(np.concatenate([described(b) for b, _ in known]), np.concatenate([r for _, r in known]).astype(float))
    others = [(b, r, odds(b, weights)) for b, r in _labelled(html_sample.CHOOSING, 2)]
    best = min((sum(int((np.array(cut(b, found, *pair)) != r).sum()) for b, r, found in others), *pair) for pair in ((s, a) for s in (0.0, 0.5, 1.0, 1.5, 2.0, 3.0) for a in (0.0, 0.1, 0.25, 0.5)))
    return tuple(weights.tolist()), best[1], best[2]


def label(blocks: list[Block], model: Model | None = None) -> list[bool]:
    """Content or not, for every block of a page."""
    weights, strength, across = model or fitted()
    return cut(blocks, odds(blocks, np.array(weights)), strength, across) if blocks else []


def main_text(page: str | None, model: Model | None = None) -> str:
    """The article of a page, a line for each block."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, model), strict=True) if keep)


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(x.as_py(), model) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html)."""
    bound_batches(pages.sparkSession)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(_extract(fitted()), "page_id bigint, url string, text string, n_chars bigint")
