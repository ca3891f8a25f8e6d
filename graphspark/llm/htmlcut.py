"""HTML main text by minimum cut.

A page is read into blocks of text.  A linear classifier over a block's place in the DOM,
its length, its share of link text and its punctuation gives the cost of calling it content
or boilerplate; these costs are the capacities from the source and to the sink.  Weights of
places are given (``ELEMENT``, ``WORDS``).  Those of the text are fitted by logistic
regression, drawn towards given ones, on at most ``SAMPLE`` pages: there, blocks whose place
alone leaves no doubt are the labels, so that what is learnt from clearly marked pages
helps where a page marks nothing.  Neighbouring blocks, and
neighbours under one parent, are joined by edges whose capacities fall with their distance
in the DOM.  The minimum cut, found by maximum flow, parts content from boilerplate with the
least sum of classifier costs and broken edges.

Defined cases: null or empty html gives the empty text, as does a page without content;
unclosed, stray and cut-off markup is read as far as it goes; repeated rows give one row
each; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, short_batches

SLICE = 4 << 20

#: A tag whose quote is never closed ends at the next >.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_PART = re.compile(r"[a-z]+")

#: Elements of HTML by kind: fixed values of the HTML standard.
RAW = frozenset("script style noscript template iframe object svg math textarea select title head xmp noembed noframes canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes when it is open, and what stops the search for it.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table article section div body main aside nav footer header form blockquote td th menu".split())

#: Log odds of content for being inside an element, or inside one whose class, id or role has a word.
ELEMENT = {
    "article": 3.0, "main": 2.5, "nav": -9.0, "footer": -8.0, "aside": -8.0, "header": -3.0, "form": -8.0, "menu": -7.0, "search": -8.0,
    "button": -7.0, "label": -5.0, "dialog": -8.0, "address": -2.0, "fieldset": -7.0, "blockquote": 0.3, "h1": 1.2, "h2": 0.6, "h3": 0.6, "p": 0.8, "pre": 0.8, "li": -0.2,
}
WORDS = {
    **dict.fromkeys("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner".split(), -9.0),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc".split(), -8.0),
    **dict.fromkeys("sidebar aside widget related recommended recommendations trending popular".split(), -8.0),
    **dict.fromkeys("comment comments disqus reply replies respond".split(), -9.0),
    **dict.fromkeys("cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login".split(), -9.0),
    **dict.fromkeys("footer copyright legal share sharing social masthead complementary contentinfo search".split(), -8.0),
    **dict.fromkeys("article content entry post story main maintext articlebody".split(), 1.5),
}
#: What follows these in a class name is told to be beside, or absent from, the element.
BESIDE = frozenset("with without has no hide".split())
#: Given weights of the text: tens of words up to four, share of link text, under four words, end of a sentence.
GIVEN = (0.6, -4.0, -0.5, 0.0)
#: Pages to fit on, odds of a place that leave no doubt, and the pull to the given weights for each block.
SAMPLE, SURE, PULL = 500, (3.0, -6.0), 0.05
#: Edge capacities for neighbours in page order, and for neighbours under one parent.
NEAR, SIBLING = 1.2, 0.8
SCALE = 1000


class Block:
    __slots__ = ("text", "path", "odds", "linked")

    def __init__(self, text: str, path: tuple[int, ...], odds: float, linked: float):
        self.text, self.path, self.odds, self.linked = text, path, odds, linked


def name_odds(name: str, content: bool) -> float:
    """Of one class, id or role.  The name of an article or main element that has a word for
    content doesn't make it boilerplate by another word."""
    found = []
    for part in _NAME_PART.findall(name):
        if part in BESIDE:
            break
        if part in WORDS:
            found.append(WORDS[part])
    if not found:
        return 0.0
    return max(found) if content and max(found) > 0 else min(found)


def place_odds(tag: str, attributes: str) -> float:
    odds = ELEMENT.get(tag, 0.0)
    if attributes and tag not in ("html", "body"):
        names = []
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role"):
                names += (a or b or c).lower().split()
            elif name == "aria-hidden" and (a or b or c).lower() == "true":
                odds -= 9.0
        found = [x for x in (name_odds(n, tag in ("article", "main")) for n in names) if x]
        if found:
            odds += min(found)
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes.lower()):
            odds -= 9.0
    return odds


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block-level tags, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # tag, number, odds so far
    parts: list[str] = []
    linked = 0
    number = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            path = tuple(n for tag, n, _ in stack if tag in BLOCK or not tag)
            out.append(Block(text, path, stack[-1][2], min(1.0, linked / len(text))))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = entities.unescape(page[at:stop])
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if not m.group(1):
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag in ("head", "svg", "math", "object", "select", "audio", "video", "canvas", "noscript", "template") and not close:
                    continue
                at = close.end() if close else end
                if tag in BLOCK:
                    flush()
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in BLOCK:
                flush()
                shut = CLOSES.get(tag, ("p",) if tag not in ("html", "body") else ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in shut:
                        links -= sum(1 for t in stack[k:] if t[0] == "a")
                        del stack[k:]
                        break
                    if stack[k][0] in STOPS:
                        break
            if m.group(3).endswith("/") and tag not in BLOCK:
                continue
            number += 1
            stack.append((tag, number, stack[-1][2] + place_odds(tag, m.group(3))))
            if tag == "a":
                links += 1
        else:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    links -= sum(1 for t in stack[k:] if t[0] == "a")
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK and stack[k][0] != "p":
                    break
    flush()
    return out


def text_features(block: Block) -> tuple[float, ...]:
    words = block.text.count(" ") + 1
    return min(words, 40) / 10, block.linked, float(words < 4), float(block.text[-1] in ".!?")


def fit_weights(pages: list[str], given: tuple[float, ...] = GIVEN, pull: float = PULL) -> tuple[float, ...]:
    """Weights of the text by logistic regression on blocks whose place is sure, drawn to the
    given ones; without blocks of both kinds these are the result."""
    x, y = [], []
    for page in pages:
        for block in blocks_of(page):
            if block.odds >= SURE[0] or block.odds <= SURE[1]:
                x.append(text_features(block))
                y.append(block.odds > 0)
    if not any(y) or all(y):
        return given
    x, y, start = np.array(x), np.array(y, float), np.array(given)
    # each kind has half the weight; the constant is free, and left out afterwards: places give it
    weight = np.where(y > 0, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    x, pulls = np.column_stack([x, np.ones(len(y))]), np.append(np.full(len(given), pull * len(y)), 1e-6)
    w = goal = np.append(start, 0.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pulls * (w - goal)
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pulls), gradient)
    return tuple(w[:-1].tolist())


def log_odds(block: Block, weights: tuple[float, ...] = GIVEN) -> float:
    """Of being content, by the classifier."""
    return block.odds + sum(w * x for w, x in zip(weights, text_features(block), strict=True))


def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Neighbours in page order, and neighbours under one parent that aren't adjacent."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, int(SCALE * NEAR / (1 + distance(blocks[i - 1].path, block.path)))))
        parent = block.path[:-1]
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, int(SCALE * SIBLING / 3)))
        last[parent] = i
    return out


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source.  A gain above 0 is the capacity from the source,
    one below 0 that to the sink; edges have equal capacities both ways.

    A node whose own capacity outweighs all its edges lies on that side in a minimum cut; it
    is settled, and its edges add to the gains of its neighbours.  What is left falls into
    parts, mostly very small, which ``augment`` cuts one by one.
    """
    n = len(gain)
    left, side, held = list(gain), [None] * n, [0] * n
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if c > 0 and a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
            held[a] += c
            held[b] += c
    todo = list(range(n))
    while todo:
        v = todo.pop()
        if side[v] is not None or -held[v] < left[v] <= held[v]:
            continue
        side[v] = left[v] > 0
        for u, c in near[v].items():
            if side[u] is None:
                held[u] -= c
                left[u] += c if side[v] else -c
                todo.append(u)
    for start in range(n):
        if side[start] is None:
            part, number = [start], {start: 0}
            for v in part:
                for u in near[v]:
                    if side[u] is None and u not in number:
                        number[u] = len(part)
                        part.append(u)
            links = [(number[v], number[u], c) for v in part for u, c in near[v].items() if u in number and v < u]
            for v, keep in zip(part, augment([left[v] for v in part], links), strict=True):
                side[v] = keep
    return side


def augment(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The same by maximum flow: shortest augmenting paths are saturated until none is left."""
    n = len(gain)
    to, room, near = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [c, c]
    left = list(gain)
    sources = [i for i in range(n) if left[i] > 0]
    while True:
        came = [-2] * n
        for i in sources:
            if left[i] > 0:
                came[i] = -1
        queue = [i for i in sources if left[i] > 0]
        meet = -1
        for v in queue:
            if left[v] < 0:
                meet = v
                break
            for e in near[v]:
                if room[e] > 0 and came[to[e]] == -2:
                    came[to[e]] = e
                    queue.append(to[e])
        if meet < 0:
            return [x != -2 for x in came]
        flow, v = -left[meet], meet
        while came[v] >= 0:
            flow = min(flow, room[came[v]])
            v = to[came[v] ^ 1]
        flow = min(flow, left[v])
        left[v] -= flow
        left[meet] += flow
        v = meet
        while came[v] >= 0:
            room[came[v]] -= flow
            room[came[v] ^ 1] += flow
            v = to[came[v] ^ 1]


def main_text(page: str | None, weights: tuple[float, ...] = GIVEN) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = minimum_cut([int(SCALE * log_odds(b, weights)) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights of the text from about ``sample`` pages of at most 100,000 characters, those
    whose hash lies below a share of its range; never more than twice as many."""
    share = min(1.0, sample / max(pages.count(), 1))
    some = pages.select(F.col(html_col).alias("html")).where("length(html) BETWEEN 1 AND 100000")
    some = some.where(F.pmod(F.xxhash64("html"), F.lit(2**31)) < int(share * 2**31)).limit(2 * sample)
    return fit_weights(sorted(r.html for r in some.collect()))


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: tuple[float, ...] = GIVEN) -> DataFrame:
    """The columns of ``keep`` (none may be called text) and the main text of every page."""
    if {"text", "_html"}.intersection(keep):
        raise ValueError("a kept column has the name of the result")
    short_batches(pages.sparkSession)
    chosen = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "_html", SLICE):
                texts = [main_text(x, weights) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return chosen.mapInArrow(extracted, f"{fields}, text string")
