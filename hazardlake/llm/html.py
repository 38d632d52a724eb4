"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their place in the document tree.  A
linear classifier gives every block a log-odds of being content; its two parts
are the capacities to the terminals.  Smoothness edges join blocks that follow
each other and blocks of one parent, the stronger the closer they lie in the
tree.  A maximum flow then separates content from boilerplate.

Blocks whose own evidence outweighs all their edges are settled first (that is
exact: no cut could gain by the other label); the flow runs on the rest.

NULL and empty pages have the empty text.  Pages cut off in the middle are read
to their end.  Nothing is dropped from a block: its character references are
decoded, white space becomes one space, blocks are joined by a line break.
"""
from __future__ import annotations

import re
from collections import deque
from html import unescape
from math import log1p

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hazardlake.llm.common import add_columns

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements whose text is never shown as text of the page.
SKIPPED = {"script", "style", "template", "noscript", "iframe", "object", "svg", "math", "title", "textarea", "select", "canvas", "audio", "video"}
#: Elements that do not interrupt a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "img", "label", "input", "picture", "source", "map", "area", "nobr", "center"}
VOID = {"br", "hr", "meta", "link", "base", "col", "embed", "param", "track", "img", "input", "wbr", "area", "source"}
#: A start tag of the key ends an open element of these kinds.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"},
          "th": {"td", "th", "p"}, "option": {"option"}}
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
BOILER_WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
                "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "header", "footer", "sidebar", "aside",
                "widget", "related", "recommended", "share", "sharing", "social", "comment", "comments", "reply", "replies", "disqus",
                "respond", "discussion", "cookie", "cookies", "notice", "notices", "notification", "alert", "consent", "gdpr", "popup",
                "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager",
                "toolbar", "copyright", "legal", "contentinfo", "complementary", "skip", "form", "disclaimer", "tagcloud"}
CONTENT_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
BOILER, NEUTRAL, CONTENT = -1, 0, 1


class Block:
    __slots__ = ("text", "chars", "links", "region", "parent", "path", "heading")

    def __init__(self, text, links, region, path, heading):
        self.text, self.chars, self.links, self.region, self.path, self.heading = text, len(text), links, region, path, heading
        self.parent = path[-1] if path else 0


def _region(tag: str, attributes: str, outer: int, sticky: bool) -> tuple[int, bool]:
    """Region of an element inside a region; sticky boilerplate holds whatever stands in it."""
    words: set = set()
    hidden = False
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name != "style":
                words.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
    if sticky:
        return BOILER, True
    if hidden or tag in BOILER_TAGS:
        return BOILER, True
    if tag in ("html", "body"):
        return outer, False
    if tag == "main":
        return CONTENT, False
    if words & BOILER_WORDS and not (tag in CONTENT_TAGS and words & CONTENT_WORDS):
        return BOILER, True
    if tag == "header":
        return (outer, False) if outer == CONTENT else (BOILER, True)
    if tag == "article":
        return CONTENT, False
    return outer, False


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple] = []                  # (tag, number, region, sticky) of open elements that interrupt blocks
    parts: list[str] = []
    links = in_link = number = at = 0
    heading = False

    def close():
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), stack[-1][2] if stack else NEUTRAL, tuple(s[1] for s in stack), heading))
            parts, links = [], 0

    def add(raw):
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text)

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag, ending, attributes = name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if tag in SKIPPED and not ending:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = found.end() if found else size
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ending else 1
            continue
        close()
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            in_link = 0
        elif tag not in VOID:
            gone = CLOSES.get(tag, {"p"})
            while stack and stack[-1][0] in gone:
                stack.pop()
            outer, sticky = (stack[-1][2], stack[-1][3]) if stack else (NEUTRAL, False)
            number += 1
            if tag == "body":
                stack.clear()
                outer, sticky = NEUTRAL, False
            stack.append((tag, number, *_region(tag, attributes, outer, sticky)))
            heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            continue
        heading = bool(stack) and len(stack[-1][0]) == 2 and stack[-1][0][0] == "h" and stack[-1][0][1].isdigit()
    close()
    return out


def log_odds(b: Block) -> float:
    """Linear classifier of a block by itself: above 0 for content."""
    words = b.text.count(" ") + 1
    marks = b.text.count(".") + b.text.count(",")
    score = -1.6 + 0.9 * log1p(words) - 5.0 * b.links / b.chars + (0.6 if marks else 0.0) + (0.6 if b.heading else 0.0)
    score -= 3.0 if "©" in b.text[:80] else 0.0
    return max(-4.0, min(4.0, score)) + (8.0 if b.region == CONTENT else -14.0 if b.region == BOILER else 0.0)


def proximity(a: Block, b: Block) -> float:
    """Strength of an edge: falls with the way between two blocks in the tree; weak between different regions."""
    same = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        same += 1
    way = len(a.path) + len(b.path) - 2 * same
    return (2.0 if a.region == b.region else 0.4) / (1 + 0.5 * way)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict = {}                          # latest block below a grandparent, to join siblings across others
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, proximity(blocks[i - 1], b)))
        up = b.path[-2] if len(b.path) > 1 else b.parent
        j = last.get(up)
        if j is not None and j < i - 1:
            out.append((j, i, 0.5 * proximity(blocks[j], b)))
        last[up] = i
    return out


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: odds beyond 0 are lost by the other label, edges by different labels."""
    n = len(odds)
    odds = list(odds)
    near: list[dict] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) >= sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, odds, near)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(nodes, odds, near) -> set:
    """Nodes on the source's side after shortest augmenting paths (source: content)."""
    s, t = -1, -2
    left: dict = {s: {}, t: {}}
    for i in nodes:
        left[i] = dict(near[i])
    for i in nodes:
        if odds[i] > 0:
            left[s][i], left[i][s] = odds[i], 0.0
        elif odds[i] < 0:
            left[i][t], left[t][i] = -odds[i], 0.0
    while True:
        came = {s: None}
        queue = deque([s])
        while queue and t not in came:
            x = queue.popleft()
            for y, c in left[x].items():
                if c > 1e-12 and y not in came:
                    came[y] = x
                    queue.append(y)
        if t not in came:
            return set(came) - {s}
        path, y = [], t
        while came[y] is not None:
            path.append((came[y], y))
            y = came[y]
        flow = min(left[x][y] for x, y in path)
        for x, y in path:
            left[x][y] -= flow
            left[y][x] = left[y].get(x, 0.0) + flow


def main_text(html: str | None) -> tuple[str, int, int]:
    """Text of the content blocks, their number, and that of all blocks."""
    blocks = blocks_of(html) if html else []
    if not blocks:
        return "", 0, 0
    keep = min_cut([log_odds(b) for b in blocks], edges_of(blocks))
    chosen = [b.text for b, k in zip(blocks, keep) if k]
    return "\n".join(chosen), len(chosen), len(blocks)


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
          T.StructField("n_content", T.IntegerType()), T.StructField("n_blocks", T.IntegerType())]


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Append text, n_chars, n_content and n_blocks of every page; other columns pass through."""
    def make():
        def run(pages):
            found = [main_text(p) for p in pages]
            return [[f[0] for f in found], [len(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]]
        return run

    return add_columns(df, [column], FIELDS, make)
