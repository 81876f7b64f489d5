"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks (the text between block-level tags). For each block, evidence from its tags, the names
of its containers, its links and its prose is summed to a score; as a classifier's cost it becomes the
capacity of an edge from the content terminal (score above 0) or to the boilerplate terminal (below).
Smoothness edges join neighbouring blocks and consecutive blocks of one parent, stronger the closer they are in
the tree. The minimum cut, found by maximum flow, labels the blocks; content blocks are joined by ``\\n``.

What is never text (scripts, styles, titles, comments in the markup, controls of forms) makes no block.
Character references are decoded once; white space in a block becomes one space. ``<br>`` counts as white space.

Pages are independent: one pass, no shuffle; memory is bounded by one page. The flow network has at most three
edges a block.

Cases: null or empty html gives empty text; unclosed tags, stray ends and broken markup are read as far as they
go (text without any tag is one block); a null id or url is passed on; repeated rows are rows; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidewatch.llm.common import map_columns

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript title textarea template iframe svg math object select button canvas audio video".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Evidence of an open element by its name, for every block inside.
ELEMENT = {"article": 3.0, "main": 2.5, "nav": -8.0, "footer": -7.0, "aside": -7.0, "form": -8.0, "fieldset": -8.0, "menu": -7.0,
           "dialog": -7.0, "header": -2.5, "head": -20.0, "figcaption": 0.5, "blockquote": 0.5, "pre": 0.5}
#: Evidence of a word in an element's class, id or role.
NAMED_BAD = re.compile(r"^(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|aside|menu\w*|nav\w*|breadcrumbs?|footer|foot|header|masthead|"
                       r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|commentlist|replies|reply|disqus|respond|share|sharing|social|"
                       r"related|recommend\w*|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|copyright|legal|complementary|"
                       r"contentinfo|navigation|dialog|form|tags?|skip)$")
NAMED_GOOD = re.compile(r"^(?:article\w*|content|main|post|entry|story|body|text|prose)$")
NAMED_COST, NAMED_GAIN = -7.0, 1.5
#: Evidence of the block's own element; others have a little against them.
TAGGED = {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "": 0.3, "body": 0.3} | dict.fromkeys(HEADINGS, 0.8)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}


@dataclass
class Block:
    text: str
    linked: int
    score: float
    tag: str
    path: tuple


@dataclass
class _Open:
    name: str
    score: float
    number: int
    named: float = 0.0
    inside: bool = field(default=False)  # within an article or main element
    holds: bool = field(default=False)  # an article or main element opened within it

    def evidence(self) -> float:
        # What wraps the article (a body of class "has-sidebar") says nothing against it.
        return self.score + (max(0.0, self.named) if self.holds else self.named)


def _named(name: str, attributes: str, inside: bool) -> float:
    """Evidence of an element's own names; the page's outermost elements and the article itself have none against them."""
    if "=" not in attributes:
        return 0.0
    found = [w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")]
    good = any(NAMED_GOOD.match(w) for w in found)
    bad = {w for w in found if NAMED_BAD.match(w)}
    if bad <= {"header", "masthead"} and (good or inside):
        bad = set()  # the head of the article
    if bad and name not in ("html", "body", "main", "article"):
        return NAMED_COST
    return NAMED_GAIN if good else 0.0


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, each with the evidence of its containers."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", 0.0, 0)]
    open_: dict[str, int] = {}
    parts: list[str] = []
    holders: list[tuple] = []
    linked = number = at = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            holder = next((e for e in reversed(stack) if e.name in BLOCK), stack[0])
            out.append(Block(text, linked, 0.0, holder.name, tuple(e.number for e in stack if e.name in BLOCK)))
            holders.append(tuple(e for e in stack if e.score or e.named))
        linked = 0

    def close(name: str):
        while len(stack) > 1:
            e = stack.pop()
            open_[e.name] -= 1
            if e.name == name:
                return

    while at < len(page):
        m = _TAG.search(page, at)
        till = m.start() if m else len(page)
        if till > at:
            text = page[at:till]
            parts.append(text)
            if open_.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1] or m[4]:
            if open_.get(name):
                close(name)
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            continue
        if name in VOID:
            continue
        if name in BLOCK and open_.get("p"):
            close("p")
        elif name == "li" and open_.get("li") and next((e.name for e in reversed(stack) if e.name in ("li", "ul", "ol")), "") == "li":
            close("li")
        if name == "li" and stack[-1].name == "li":
            close("li")
        number += 1
        inside = stack[-1].inside or name in ("article", "main")
        score = ELEMENT.get(name, 0.0)
        if name == "header" and stack[-1].inside:
            score = 0.5
        if name in ("article", "main"):
            for e in stack:
                e.holds = True
        stack.append(_Open(name, score, number, _named(name, attributes, stack[-1].inside), inside))
        open_[name] = open_.get(name, 0) + 1
    flush()
    for b, held in zip(out, holders):
        b.score = sum(e.evidence() for e in held)
    return out


def content_score(b: Block) -> float:
    """Evidence that a block is content: its containers, links and prose."""
    n = len(b.text)
    s = b.score - 4.0 * min(1.0, b.linked / n)
    s += min(2.0, n / 120) + (0.8 if b.text[-1] in ".!?…:;\"'”»)" else 0.0) + TAGGED.get(b.tag, -0.4)
    if "©" in b.text[:40] or "all rights reserved" in b.text.lower():
        s -= 4.0
    return s


def smoothness(a: Block, b: Block) -> float:
    """Capacity between two blocks: the smaller, the more containers lie between them."""
    same = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        same += 1
    return 1.5 / (1.0 + 0.5 * max(0, len(a.path) + len(b.path) - 2 * same - 2))


class Flow:
    """Maximum flow by level graphs; terminals are the nodes 0 (source) and 1 (sink)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, capacity: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(capacity)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self) -> list[int]:
        level = [-1] * len(self.out)
        level[0] = 0
        todo = deque([0])
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def run(self) -> list[bool]:
        """Push all flow; which nodes stay on the source's side of the cut."""
        while (level := self.levels())[1] >= 0:
            tried = [0] * len(self.out)
            path: list[int] = []
            a = 0
            while True:
                if a == 1:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while tried[a] < len(self.out[a]):
                    e = self.out[a][tried[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    a = self.to[e ^ 1]
                    tried[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return [x >= 0 for x in level]


def label(page_blocks: list[Block]) -> list[bool]:
    """Whether each block is content, by the minimum cut."""
    flow = Flow(len(page_blocks) + 2)
    last: dict[tuple, int] = {}
    for i, b in enumerate(page_blocks):
        s = content_score(b)
        if s > 0:
            flow.edge(0, i + 2, s)
        elif s < 0:
            flow.edge(i + 2, 1, -s)
        if i:
            w = smoothness(page_blocks[i - 1], b)
            flow.edge(i + 1, i + 2, w, w)
        before = last.get(b.path[:-1])
        if before is not None and before != i - 1:
            w = smoothness(page_blocks[before], b)
            flow.edge(before + 2, i + 2, w, w)
        last[b.path[:-1]] = i
    return flow.run()[2:]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, label(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    def run(batches):
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield {"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_columns(pages.select("page_id", "url", "html"), run, SCHEMA)
