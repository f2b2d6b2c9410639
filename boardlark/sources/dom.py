"""A small document tree over the standard HTML tokenizer, with the selectors that page descriptions need.

Selectors: tag, #id, .class, [attr], [attr=v], [attr*=v], [attr^=v], blank for descendants, > for children, comma for alternatives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind closes an open one of the second kinds.
CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def nodes(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.nodes()

    def text(self, between: str = "") -> str:
        """The stripped texts below, joined."""
        return between.join(t for t in (s.strip() for s in self.strings()) if t)

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style", "#comment"):
                yield from c.strings()

    def select(self, selector: str) -> list[Node]:
        wanted = _selector(selector)
        return [n for n in self.nodes() if any(_matches(n, chain, self) for chain in wanted)]

    def first(self, selector: str) -> Node | None:
        wanted = _selector(selector)
        return next((n for n in self.nodes() if any(_matches(n, chain, self) for chain in wanted)), None)


_PART = re.compile(r"([\w-]+|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^]?=)['\"]?([^\]'\"]*)['\"]?)?\]")


@lru_cache(512)
def _selector(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a list of (relation to what stands before, tests), the last node first."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", text):
        chain, relation = [], " "
        for word in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", alternative):
            if word == ">":
                relation = ">"
                continue
            chain.append((relation, [m for m in _PART.findall(word)]))
            relation = " "
        out.append(chain[::-1])
    return out


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, own_id, cls, attr, op, value in tests:
        if tag and tag not in ("*", node.tag):
            return False
        if own_id and node.get("id") != own_id:
            return False
        if cls and cls not in node.classes:
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None or (op == "=" and have != value) or (op == "*=" and value not in have) or (op == "^=" and not have.startswith(value)):
                return False
    return True


def _matches(node: Node, chain: list, top: Node) -> bool:
    relation, tests = chain[0]
    if not _fits(node, tests):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    while up is not None and up is not top.parent:
        if _matches(up, chain[1:], top):
            return True
        if relation == ">":
            return False
        up = up.parent
    return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.now = Node("#document")

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, ())
        if tag in BLOCKS and self.now.tag == "p":
            self.now = self.now.parent
        at = self.now
        while closes and at.parent is not None and at.tag not in ("table", "ul", "ol", "dl", "select"):
            if at.tag in closes:
                self.now = at.parent
                if at.tag == tag or tag != "tr":
                    break
            at = at.parent
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.top
