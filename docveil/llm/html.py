"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docveil.llm.mincut import min_cut

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: HTML's elements (fixed values) by what they do here.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object title xmp noembed noframes".split())
#: Those of them that a slash in the opening tag closes.
FOREIGN = frozenset({"svg", "math"})
#: Open elements that a new one closes, up to the given container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
HEADINGS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p pre blockquote dd".split())

#: What an element's name, or a word of its class, id or role, says of the text in it (fixed values): parts of pages that are no article.
PART_TAGS = frozenset("nav footer aside form menu button select dialog header fieldset search head".split())
PART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar toolbar skip "
    "footer masthead header complementary contentinfo "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login paywall alert disclaimer "
    "comment comments reply replies disqus respond discussion "
    "related recommended recommendations share sharing social widget tags copyright search trending".split()
)
MAIN_TAGS, MAIN_WORDS = frozenset({"article", "main"}), frozenset("article articlebody main content post entry story".split())

PLAIN, MAIN, PART, HEAD = "plain", "main", "part", "head"


@dataclass(slots=True)
class Element:
    """region is the number of the innermost element that says what its text is, kind what it says; inner and outer are the innermost two blocks."""

    tag: str
    number: int
    kind: str
    region: int
    inner: int
    inner_tag: str
    outer: int
    depth: int
    link: bool


_TOP = Element("", 0, PLAIN, 0, 0, "", 0, 0, False)


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    kind: str
    region: int
    inner: int
    outer: int
    linked: int

    def features(self) -> list[float]:
        """Of the text alone: size, share in links, sentence marks, heading, paragraph."""
        n = len(self.text)
        marks = sum(map(self.text.count, ".,;:!?"))
        return [1.0, min(3.0, math.log1p(n) / 2), self.linked / n, min(1.0, 20 * marks / n), float(self.tag in HEADINGS), float(self.tag in PARAGRAPHS)]


def _said(tag: str, attrs: str) -> str:
    """What an element alone says of its text."""
    part, main = tag in PART_TAGS, tag in MAIN_TAGS
    for m in _ATTRIBUTE.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return PART
        if name in ("class", "id", "role", "itemprop") and tag not in ("html", "body"):
            words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
            part = part or not PART_WORDS.isdisjoint(words)
            main = main or not MAIN_WORDS.isdisjoint(words)
    return PART if part else MAIN if main else PLAIN


def _element(tag: str, attrs: str, number: int, above: Element) -> Element:
    """An element in another one. In a part of the page everything is of that part, but for <main>; an article's own head is a part that may be none."""
    said, kind = _said(tag, attrs), above.kind
    if said == MAIN and (kind != PART or tag == "main"):
        kind = MAIN
    elif said == PART and kind != PART:
        kind = HEAD if tag == "header" and kind in (MAIN, HEAD) else PART
    region = number if (kind, said) != (above.kind, PLAIN) and said != PLAIN else above.region
    block = tag in BLOCKS
    return Element(tag, number, kind, region, number if block else above.inner, tag if block else above.inner_tag, above.inner if block else above.outer, above.depth + 1, above.link or tag == "a")


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, character references decoded, white space made single."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked, made, at = 0, 0, 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack and stack[-1].link:
                linked += len(_SPACE.sub(" ", text).strip(" "))

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip(" ")
        parts.clear()
        if text:
            e = stack[-1] if stack else _TOP
            out.append(Block(text, e.inner_tag, e.kind, e.region, e.inner, e.outer, min(linked, len(text))))
        linked = 0

    def drop(closed: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """Close the innermost of some elements, unless one of others lies further in."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in closed:
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            close()
        if m[1] or m[4]:
            drop({tag}, frozenset())
            continue
        if tag in BLOCKS:
            drop({"p"}, BLOCKS)
        if tag in CLOSES:
            drop(*CLOSES[tag])
        if tag == "br":
            parts.append(" ")
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            if not (tag in FOREIGN and attrs.endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in VOID:
            made += 1
            stack.append(_element(tag, attrs, made, stack[-1] if stack else _TOP))
    put(page[at:])
    close()
    return out


#: Terminal capacities: what an element's word for its text counts, and how far the text's own evidence may go.
SAID = {PLAIN: 0.0, MAIN: 2.0, HEAD: 1.0, PART: -4.0}
MOST_TEXT = 2.5
#: Weights of Block.features() before any training.
WEIGHTS = (-0.5, 0.5, -3.0, 0.5, 0.5, 0.5)
#: Edges: neighbours, more in one region, more still in one container; the next one of a container.
NEXT, REGION, SIBLING, COUSIN = 0.3, 0.5, 1.0, 0.6


def text_gain(b: Block, weights: tuple[float, ...]) -> float:
    """What the text alone speaks for, the classifier's log-odds within bounds."""
    return max(-MOST_TEXT, min(MOST_TEXT, sum(w * f for w, f in zip(weights, b.features(), strict=True))))


def graph(found: list[Block], weights: tuple[float, ...] = WEIGHTS) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Gains (terminal capacities) and edges of a page's blocks."""
    gain = [SAID[b.kind] + text_gain(b, weights) for b in found]
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            a = found[k - 1]
            same = a.region == b.region
            edges.append((k - 1, k, NEXT + REGION * same + SIBLING * (same and (a.inner == b.inner or a.outer == b.outer))))
        j = last.get((b.region, b.outer))
        if j is not None and j != k - 1:
            edges.append((j, k, COUSIN))
        last[b.region, b.outer] = k
    return gain, edges


def main_blocks(found: list[Block], weights: tuple[float, ...] = WEIGHTS) -> list[bool]:
    """Content or boilerplate, for each block, by the minimum cut.

    Terminal capacities are the classifier's costs: what the text and the
    element around it say. Edges join neighbours and the blocks of one container, so a block that says little goes with those beside it.
    """
    return min_cut(*graph(found, weights))


def main_text(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, main_blocks(found, weights), strict=True) if keep)


def train_weights(pages: list[str | None], rounds: int = 25, ridge: float = 5.0) -> tuple[float, ...]:
    """Weights of the text features, by logistic regression on blocks whose elements say what they are.

    The ridge pulls towards WEIGHTS, which also stand if only one label occurs.
    """
    rows, labels = [], []
    for page in pages:
        for b in blocks(page or ""):
            if b.kind in (MAIN, PART):
                rows.append(b.features())
                labels.append(b.kind == MAIN)
    start = np.array(WEIGHTS)
    if len(set(labels)) < 2:
        return WEIGHTS
    x, y, beta = np.array(rows), np.array(labels, float), start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (p - y) + ridge * (beta - start))
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in beta)


def extract_text(pages: DataFrame, sample: int = 300, seed: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    The classifier is fitted on at most sample pages, those with the smallest hashes
    of page_id, so reruns agree; every page is then labelled whole. A null
    html is empty; a page without content has an empty text. Repeated rows come back as often, an empty table gives an empty
    one, and other columns, also one named text or n_chars, are not read.
    """
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"))
    order = F.xxhash64(F.lit(seed), "page_id")
    last = rows.select(order.alias("o")).orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    first = rows.where(order <= F.lit(last)).select("html").limit(sample).collect() if last is not None else []
    weights = train_weights([r[0] for r in first])
    return pages.select("page_id", "url", F.arrow_udf(_extractor(weights), "string")(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _extractor(weights: tuple[float, ...]):
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return extract
