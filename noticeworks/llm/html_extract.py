"""Main text of web pages by a minimum cut.

A page is read into text blocks.  A classifier gives each block the cost of calling it content and of calling it boilerplate; the costs are
capacities to the two terminals.  Its odds are argued on structure: length, share of linked text, the end of a sentence, headings, the landmarks around the
block and whether the page has an article elsewhere; names of classes speak last.  Short blocks are left close to even, because alone they tell nothing.
Blocks that follow one another, and blocks of one parent, are tied by smoothness edges that weaken with their distance
in the document tree and are nearly cut at the border of a landmark or of a named container, inside which blocks stand or fall together.  The maximum flow
between the terminals gives the cheapest labelling; the content side is the main text.

Cases: a null or empty page has an empty text; broken markup is read as far as it goes (an element that holds no text to read and is
never closed hides nothing, a head ends at the first element of the body); very long pages are read whole; repeated rows
are read each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

# Element groups of HTML.
RAW = frozenset("script style textarea title".split())
IGNORED = frozenset("noscript template svg iframe object math canvas head select button".split())
OF_HEAD = frozenset("base link meta title style script noscript template head html".split())
HEADINGS = frozenset("h1 h2 h3".split())
FOREIGN = frozenset("svg math".split())
HTML_IN_FOREIGN = frozenset("foreignobject desc annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
OWN_TEXT = frozenset("article main".split())
FAR_FROM_TEXT = frozenset("nav footer aside form menu dialog fieldset".split())
# Words of class and id attributes.
AGAINST = frozenset("ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner sidebar comment comments reply replies discussion disqus cookie cookies consent gdpr notice notices alert popup modal menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended widget newsletter subscribe signup login form search pagination pager toolbar disclaimer copyright masthead commentlist respond".split())
FOR = frozenset("article content post story entry body main text".split())
MODIFIERS = frozenset("has with without no is not".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


#: Weights of the edges between neighbours and between blocks of one parent, and the share of them that a border leaves.
ADJACENT, SIBLING, ACROSS_BORDER = 1.6, 1.0, 0.05


@dataclass
class Node:
    """An open element: its tag, its number and what its ancestors and attributes say about it."""

    tag: str
    number: int
    depth: int
    against: bool = False
    article: bool = False
    header: bool = False
    liked: bool = False
    link: bool = False
    parent: Node | None = None
    ignored: bool = False
    border: int = 0
    landmark: bool = False


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _words(attributes: str) -> set[str]:
    """Words of the class, id and role names of an element; names such as has-sidebar speak of others."""
    names = [PART.findall(name) for m in ATTRIBUTE.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").split()]
    return {p.lower() for parts in names if parts and parts[0].lower() not in MODIFIERS for p in parts}


def _open(tag: str, attributes: str, parent: Node, number: int) -> Node:
    words = _words(attributes) if attributes else set()
    article = parent.article or tag in OWN_TEXT
    named = bool(words & AGAINST) and tag not in ("html", "body", *OWN_TEXT)
    header = tag == "header" and not parent.article
    border = number if named or header or tag in FAR_FROM_TEXT or tag in OWN_TEXT else parent.border
    landmark = parent.landmark or tag in FAR_FROM_TEXT
    return Node(tag, number, parent.depth + 1, parent.against or named, article, parent.header or header, parent.liked or bool(words & FOR), parent.link or tag == "a", parent, parent.ignored or tag in IGNORED, border, landmark)


def _out_of(at: Node, tag: str) -> Node:
    """The element that a start tag belongs to: a head ends at the first element of a body, svg and math at a block of HTML."""
    inside = at
    while inside.ignored and inside.tag not in HTML_IN_FOREIGN:
        if (inside.tag == "head" and tag not in OF_HEAD and (at is inside or tag == "body")) or (inside.tag in FOREIGN and (tag in CLOSES_P or tag == "body")):
            return _out_of(inside.parent, tag)
        inside = inside.parent
    return at


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, without those of elements that never hold text to read."""
    root = Node("", 0, 0)
    at, number, done, found, here = root, 0, 0, [], None
    n = len(page)

    closed: dict[str, int] = {}

    def is_closed(tag: str) -> bool:
        """Whether an end tag follows; the last one of each name is looked up once."""
        if tag not in closed:
            closed[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", page, re.I)), default=-1)
        return closed[tag] >= done

    def text(piece: str) -> None:
        nonlocal at, here
        if at.tag == "head" and piece.strip():
            at = at.parent
        if at.ignored:
            return
        if here is None:
            if not piece.strip():
                return
            here = Block(at)
            found.append(here)
        value = entities.unescape(piece) if "&" in piece else piece
        here.parts.append(value)
        if at.link:
            here.linked += len(value.strip())

    while done < n:
        m = TOKEN.search(page, done)
        if m is None:
            text(page[done:])
            break
        if m.start() > done:
            text(page[done : m.start()])
        done = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag not in INLINE:
            here = None
        elif tag == "br" and here is not None:
            here.parts.append(" ")
        if closing:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at = up.parent
        elif tag in RAW and not (tag == "title" and attributes.endswith("/")):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, done)
            done = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            at = _out_of(at, tag)
            if tag in IGNORED and tag != "head" and not is_closed(tag):
                continue
            if tag in CLOSES_P:
                up = at
                while up is not root and up.tag in INLINE:
                    up = up.parent
                if up.tag == "p" or (up.tag == tag and tag in ("li", "dd", "dt")):
                    at = up.parent
            number += 1
            at = _open(tag, attributes, at, number)
    for block in found:
        block.text = SPACE.sub(" ", "".join(block.parts)).strip()
    return [b for b in found if b.text]


def preference(block: Block, has_article: bool) -> float:
    """The classifier: log odds that a block is content."""
    node, words = block.node, block.text.count(" ") + 1
    odds = -0.8 + min(words, 40) / 16 - 3.5 * min(1.0, block.linked / len(block.text))
    odds += 0.6 * (block.text[-1] in ".!?…\"”»") + 0.5 * (node.tag in HEADINGS)
    odds += 1.0 if node.article else -2.5 if has_article else 0.0
    return odds - 5.0 * node.landmark - 3.0 * node.header - 5.0 * node.against + 0.8 * node.liked


def nearness(a: Node, b: Node) -> float:
    """How close two elements are in the tree: the share of the deeper one's ancestors that both have; little across a border."""
    if a.border != b.border:
        return ACROSS_BORDER
    deepest = max(a.depth, b.depth, 1)
    while a is not b and a.parent and b.parent:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth / deepest if a is b else 0.0


class Flow:
    """Maximum flow by blocking flows over breadth-first levels."""

    def __init__(self, n: int):
        self.edges: list[list[list]] = [[] for _ in range(n)]

    def add(self, u: int, v: int, there: float, back: float = 0.0) -> None:
        a, b = [v, there, None], [u, back, None]
        a[2], b[2] = b, a
        self.edges[u].append(a)
        self.edges[v].append(b)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, capacity, _ in self.edges[u]:
                if capacity > 1e-9 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Pushes the maximum flow; the levels that are left are 0 or more on the source's side of the cut."""
        while (level := self.levels(source))[sink] >= 0:
            after = [0] * len(self.edges)
            path: list[list] = []
            u = source
            while True:
                if u == sink:
                    pushed = min(e[1] for e in path)
                    for e in path:
                        e[1] -= pushed
                        e[2][1] += pushed
                    path, u = [], source
                    continue
                out = self.edges[u]
                while after[u] < len(out) and not (out[after[u]][1] > 1e-9 and level[out[after[u]][0]] == level[u] + 1):
                    after[u] += 1
                if after[u] < len(out):
                    path.append(out[after[u]])
                    u = path[-1][0]
                elif not path:
                    break
                else:
                    level[u] = -1
                    u = path.pop()[2][0]
        return level


def labelled(found: list[Block], adjacent: float = ADJACENT, sibling: float = SIBLING) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    n = len(found)
    has_article = any(block.node.article for block in found)
    flow = Flow(n + 2)
    source, sink = n, n + 1
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        odds = preference(block, has_article)
        # What both terminals share flows straight through, so only the difference of the two costs is left as capacity.
        difference = math.log1p(math.exp(odds)) - math.log1p(math.exp(-odds))
        if difference > 0:
            flow.add(source, i, difference)
        else:
            flow.add(i, sink, -difference)
        if i:
            tie = adjacent * nearness(found[i - 1].node, block.node)
            if tie > 0:
                flow.add(i - 1, i, tie, tie)
        parent = block.node.parent.number if block.node.parent else 0
        if last.get(parent, i - 1) < i - 1:
            flow.add(last[parent], i, sibling, sibling)
        last[parent] = i
    side = flow.run(source, sink)
    return [side[i] >= 0 for i in range(n)]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, labelled(found), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v) for v in values], dtype="object")

    return pages.select("page_id", "url", texts("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
