"""Per-page HTML helper: a tolerant element tree and class/tag selectors.

Only the standard library is used. Where broken markup is repaired in more
than one way by browsers and parsers, see ``_CLOSED_BY`` and ``_RANK``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Text inside these elements is not page text.
_HIDDEN = frozenset("script style template rt rp".split())
_BLOCKS = frozenset(
    "address article aside blockquote center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
# Start tag -> open elements it ends when they are innermost.
_CLOSED_BY = {tag: frozenset(["p"]) for tag in _BLOCKS} | {
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
    "tr": frozenset(["p", "td", "th", "tr"]),
    "tbody": frozenset(["p", "td", "th", "tr", "thead", "tbody", "tfoot"]),
    "thead": frozenset(["p", "td", "th", "tr", "thead", "tbody", "tfoot"]),
    "tfoot": frozenset(["p", "td", "th", "tr", "thead", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
}
# An end tag does not reach across an open element of higher rank.
_RANK = {"div": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5, "table": 6, "body": 7, "html": 8}


class Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag = tag
        self.attrs = attrs
        self.classes = frozenset((attrs.get("class") or "").split())
        self.parent = parent
        self.children: list[Node | str] = []

    def descendants(self, hidden: bool = False) -> Iterator[Node | str]:
        """Elements and text below this node in document order; ``hidden`` looks into unseen elements too."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                continue
            yield child
            if isinstance(child, Node) and (hidden or child.tag not in _HIDDEN):
                stack.append(iter(child.children))

    def select(self, selector: str) -> Iterator[Node]:
        """Descendants matching any comma part of ``selector``, in document order.

        A part is a chain of ``tag``, ``.class`` or ``tag.class`` steps separated by spaces.
        """
        chains = [[_step(s) for s in part.split()] for part in selector.split(",")]
        for node in self.descendants(hidden=True):
            if isinstance(node, Node) and any(_chain_matches(node, chain) for chain in chains):
                yield node

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)

    def text(self, separator: str = "") -> str:
        """Stripped, non-empty text pieces joined by ``separator``."""
        above: Node | None = self
        while above is not None:
            if above.tag in _HIDDEN:
                return ""
            above = above.parent
        pieces = (piece.strip() for piece in self.descendants() if isinstance(piece, str))
        return separator.join(piece for piece in pieces if piece)


def _step(step: str) -> tuple[str, frozenset[str]]:
    tag, *classes = step.split(".")
    return tag.lower(), frozenset(classes)


def _chain_matches(node: Node, chain: list[tuple[str, frozenset[str]]]) -> bool:
    def fits(n: Node, step: tuple[str, frozenset[str]]) -> bool:
        return (not step[0] or n.tag == step[0]) and step[1] <= n.classes

    if not fits(node, chain[-1]):
        return False
    left = len(chain) - 2
    above = node.parent
    while left >= 0 and above is not None:
        if fits(above, chain[left]):
            left -= 1
        above = above.parent
    return left < 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)
        self.in_text = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.in_text = False
        while self.open.tag in _CLOSED_BY.get(tag, ()):
            self.open = self.open.parent
        first_wins = dict(reversed(attrs))
        node = Node(tag, first_wins, self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        self.in_text = False
        node, rank = self.open, _RANK.get(tag, 1)
        while node.parent is not None:
            if node.tag == tag:
                self.open = node.parent
                return
            if _RANK.get(node.tag, 1) > rank:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if self.in_text:
            self.open.children[-1] += data
        else:
            self.open.children.append(data)
            self.in_text = True

    def _break(self, _: str) -> None:
        self.in_text = False

    handle_comment = handle_decl = handle_pi = unknown_decl = _break


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
