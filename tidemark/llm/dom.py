"""A page as a tree of blocks, and what can be measured of each of them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead tr ul".split()
)
UNSEEN = frozenset("script style title noscript template svg iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a start tag of the same group closes, up to an enclosing one of the last column.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TABLE_PARTS = frozenset("table tbody thead tfoot td th button".split())

TAG_GROUPS = {
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "paragraph": "p pre blockquote",
    "item": "li dd dt option",
    "list": "ul ol dl menu dir",
    "table": "table tbody thead tfoot tr td th caption",
    "figure": "figure figcaption",
    "nav": "nav",
    "aside": "aside dialog details summary",
    "footer": "footer address",
    "header": "header",
    "form": "form fieldset button select textarea label legend",
    "article": "article main",
    "division": "div section center",
}
#: Parts of class, id and role names by what they usually stand for.
TOKEN_GROUPS = {
    "content": "article body content entry main post story text prose hentry",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs",
    "ad": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sponsors adslot",
    "comment": "comment comments discussion disqus reply replies respond reader readers",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay warning disclaimer message",
    "form": "form login signup signin subscribe subscription newsletter search register input",
    "side": "side sidebar aside rail widget widgets related recommended recommendations trending popular more",
    "footer": "footer foot bottom copyright legal colophon contentinfo",
    "header": "header masthead topbar top logo brand toolbar",
    "share": "share sharing social follow tweet facebook tools meta byline tags",
}
BOILERPLATE_TAGS = ("nav", "aside", "footer", "form")
MEASURES = (
    "depth chars link_share density stops words_per_leaf children place siblings page_share parent_share "
    "before after sibling_links same_tag upto leaf"
).split()
FEATURES = [
    *MEASURES,
    *(f"tag_{g}" for g in TAG_GROUPS),
    *(f"in_{g}" for g in TAG_GROUPS),
    *(f"token_{g}" for g in TOKEN_GROUPS),
    *(f"under_{g}" for g in TOKEN_GROUPS),
]

_TAG_INDEX = {tag: i for i, tags in enumerate(TAG_GROUPS.values()) for tag in tags.split()}
_TOKEN_INDEX = {token: i for i, tokens in enumerate(TOKEN_GROUPS.values()) for token in tokens.split()}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.,;:!?]")
_NAMES = ("class", "id", "role", "itemprop")


class Node:
    """An element that makes a block, or a leaf: the text between two block boundaries."""

    __slots__ = ("tag", "parent", "children", "parts", "links", "tokens", "gold", "text", "chars", "words", "stops", "tags", "leaves")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[int] = frozenset(), gold: str | None = None):
        self.tag, self.parent, self.tokens, self.gold = tag, parent, tokens, gold
        self.children: list[Node] = []
        self.parts: list[str] = []
        self.links = 0
        if parent is not None:
            parent.children.append(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.stack = [self.root]
        #: How deep the open elements of each tag are, the innermost last.
        self.depths: dict[str, list[int]] = {"html": [0]}
        self.leaf: Node | None = None
        self.anchors = 0
        self.unseen: str | None = None

    def _open(self, tag: str, tokens: frozenset[int], gold: str | None) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Node(tag, self.stack[-1], tokens, gold))

    def _innermost(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=0)

    def _close(self, tags: set[str], stops: frozenset[str] | set[str]) -> None:
        """Close the nearest open element of `tags` that lies within all of `stops`."""
        depth = self._innermost(tags)
        if depth and depth >= self._innermost(stops):
            for node in self.stack[depth:]:
                self.depths[node.tag].pop()
            del self.stack[depth:]
            self.leaf = None

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            return
        if tag in UNSEEN:
            self.unseen = tag
        elif tag == "br":
            self.handle_data(" ")
        elif tag == "a":
            self.anchors = 1
        elif tag in BLOCKS:
            self.leaf, self.anchors = None, 0
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            elif tag not in ("button", "label", "select", "textarea"):
                self._close({"p"}, TABLE_PARTS)
            if tag in VOID or tag in ("html", "body"):
                return
            names = " ".join(v for k, v in attrs if k in _NAMES and v)
            tokens = frozenset(_TOKEN_INDEX.get(t.lower(), -1) for t in _TOKEN.findall(names)) - {-1}
            gold = next((v for k, v in attrs if k == "data-gold"), None)
            self._open(tag, tokens, gold)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag == self.unseen:
                self.unseen = None
        elif tag == "a":
            self.anchors = 0
        elif tag in BLOCKS and tag not in ("html", "body"):
            self._close({tag}, frozenset())
            self.leaf, self.anchors = None, 0

    def handle_data(self, data):
        if self.unseen:
            return
        if self.leaf is None:
            if data.isspace():
                return
            self.leaf = Node("", self.stack[-1])
        self.leaf.parts.append(data)
        if self.anchors:
            self.leaf.links += len(data)


def parse(html: str | None) -> list[Node]:
    """The blocks of a page in page order, the root first; without those that have no text."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    order: list[Node] = []
    stack = [builder.root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        if node.tag:
            node.children = [c for c in node.children if c.chars]
            node.chars, node.words, node.stops, node.links, node.leaves = (
                sum(getattr(c, name) for c in node.children) for name in ("chars", "words", "stops", "links", "leaves")
            )
            node.tags = 1 + sum(c.tags for c in node.children)
        else:
            node.text = " ".join("".join(node.parts).split())
            node.chars, node.words, node.tags, node.leaves = len(node.text), node.text.count(" ") + 1, 0, 1
            node.stops = len(_STOPS.findall(node.text))
            node.links = min(node.links, node.chars)
    return [n for n in order if n.chars or n.parent is None]


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each node of a page; `nodes` as from `parse`."""
    out = np.zeros((len(nodes), len(FEATURES)), np.float32)
    n_tags, n_tokens, base = len(TAG_GROUPS), len(TOKEN_GROUPS), len(MEASURES)
    above = {id(nodes[0]): (0, frozenset(), frozenset(), 0, 1, 1, 0, 0, 0.0, 1.0)}
    page = max(1, nodes[0].chars)
    done = 0
    for row, node in zip(out, nodes):
        depth, tags, tokens, place, count, parent, before, after, sibling_links, same = above[id(node)]
        own = _TAG_INDEX.get(node.tag, -1)
        row[:base] = (
            depth, node.chars, node.links / max(1, node.chars), node.chars / (node.tags + 1), node.stops / max(1, node.words),
            node.words / max(1, node.leaves), len(node.children), place / count, count, node.chars / page,
            node.chars / max(1, parent), before, after, sibling_links, same, done / page, not node.tag,
        )
        if not node.tag:
            done += node.chars
        if own >= 0:
            row[base + own] = 1
        for i in tags:
            row[base + n_tags + i] = 1
        for i in node.tokens:
            row[base + 2 * n_tags + i] = 1
        for i in tokens:
            row[base + 2 * n_tags + n_tokens + i] = 1
        children = node.children
        if children:
            inner_tags = tags | {own} if own >= 0 else tags
            inner_tokens = tokens | node.tokens
            links = sum(c.links for c in children)
            kinds: dict[str, int] = {}
            for c in children:
                kinds[c.tag] = kinds.get(c.tag, 0) + 1
            for i, c in enumerate(children):
                above[id(c)] = (
                    depth + 1, inner_tags, inner_tokens, i, len(children), node.chars,
                    children[i - 1].chars if i else 0, children[i + 1].chars if i + 1 < len(children) else 0,
                    (links - c.links) / max(1, node.chars - c.chars), kinds[c.tag] / len(children),
                )
    return out


def decode(nodes: list[Node], chances: np.ndarray) -> str:
    """The text of the most likely choice in which nothing is kept inside what is left out.

    A node that is left out leaves out all below it; the page itself is never left out.
    """
    chances = np.clip(chances, 1e-6, 1 - 1e-6)
    yes, no = np.log(chances), np.log(1 - chances)
    at = {id(node): i for i, node in enumerate(nodes)}
    keep, drop = yes.tolist(), no.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        # Children come after their parents, so both sums are complete here.
        parent = at[id(nodes[i].parent)]
        keep[parent] += max(keep[i], drop[i])
        drop[parent] += drop[i]
    kept = [True] + [False] * (len(nodes) - 1)
    texts = []
    for i in range(1, len(nodes)):
        kept[i] = kept[at[id(nodes[i].parent)]] and keep[i] > drop[i]
        if kept[i] and not nodes[i].tag:
            texts.append(nodes[i].text)
    return " ".join(texts)
