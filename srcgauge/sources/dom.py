"""Elements of a page for a few selectors: tags, classes, attributes and whole text.

Pages repeat the same tags line after line, so a tag's source is read once (``Tag``) and
selectors look at the distinct tags of a page before they look at elements.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

# Fixed values of HTML: tags without content, tags whose content is not markup, and
# tags that end an open one of the same name.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
SELF_ENDING = frozenset("li td th tr p option dd dt".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Tags that a worker remembers by their source, and the longest source it remembers.
KNOWN_TAGS, KNOWN_LENGTH = 20_000, 200


class Tag:
    """What the source of one tag says. Elements of the same source share it."""

    __slots__ = ("name", "closes", "attributes", "classes", "void", "raw", "self_ending")

    def __init__(self, name: str, closes: bool, attributes: dict[str, str]):
        self.name, self.closes, self.attributes = name, closes, attributes
        self.classes = frozenset(attributes.get("class", "").split())
        self.void, self.raw, self.self_ending = name in VOID, name in RAW, name in SELF_ENDING


class Element:
    __slots__ = ("page", "kind", "parent", "before", "after", "last", "start", "end")

    def __init__(self, page: Page, kind: Tag, parent: Element | None, before: Element | None, at: int):
        self.page, self.kind, self.parent, self.before = page, kind, parent, before
        self.after: Element | None = None
        self.last: Element | None = None
        #: The element's pieces of the page's text.
        self.start = self.end = at

    @property
    def text(self) -> str:
        return "".join(self.page.pieces[self.start : self.end])

    def inside(self, wanted: Callable[[Element], bool]) -> bool:
        node = self.parent
        while node is not None:
            if wanted(node):
                return True
            node = node.parent
        return False


@dataclass(frozen=True)
class Selector:
    """A condition on an element's tag and, if need be, one on its place in the page."""

    tag: Callable[[Tag], bool]
    place: Callable[[Element], bool] | None = None

    def __call__(self, e: Element) -> bool:
        return self.tag(e.kind) and (self.place is None or self.place(e))


class Page:
    """All elements in page order; text pieces with entities replaced."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.pieces: list[str] = []

    @cached_property
    def tags(self) -> set[Tag]:
        return {e.kind for e in self.elements}

    def each(self, wanted: Selector) -> Iterator[Element]:
        tags = {t for t in self.tags if wanted.tag(t)}
        if tags:
            place = wanted.place
            for e in self.elements:
                if e.kind in tags and (place is None or place(e)):
                    yield e

    def all(self, wanted: Selector) -> list[Element]:
        return list(self.each(wanted))

    def first(self, wanted: Selector) -> Element | None:
        return next(self.each(wanted), None)


def has_class(*names: str, tag: str | None = None) -> Selector:
    """``.a.b`` or ``tag.a.b``."""
    wanted = frozenset(names)
    return Selector(lambda t: wanted <= t.classes and (tag is None or t.name == tag))


def has(name: str, value: str | None = None, tag: str | None = None) -> Selector:
    """``[name]`` or ``[name="value"]``, with or without a tag."""
    return Selector(
        lambda t: (
            name in t.attributes
            and (value is None or t.attributes[name] == value)
            and (tag is None or t.name == tag)
        )
    )


def under(outer: Selector, inner: Selector) -> Selector:
    """``outer inner``."""
    at = inner.place
    return Selector(inner.tag, lambda e: (at is None or at(e)) and e.inside(outer))


_known: dict[str, Tag | None] = {}


def _tag(found: re.Match) -> Tag | None:
    """The tag of a token; None for comments and the like."""
    closes, name, rest, closes_too, name_too, rest_too = found.groups()
    name = (name or name_too or "").lower()
    if not name:
        return None
    if closes or closes_too:
        return Tag(name, True, {})
    attributes = {
        k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest or rest_too or "")
    }
    return Tag(name, False, attributes)


def read(source: str) -> Page:
    """Walk the tags of a page once. An element ends with its own closing tag, or with
    an element around it; other closing tags are passed over. What raw elements hold is
    text."""
    page = Page()
    elements, pieces = page.elements, page.pieces
    node: Element | None = None
    last: Element | None = None  # outside all elements
    search, end = TOKEN.search, len(source)
    at = seek = 0  # where text goes on, and where the next token is looked for

    while True:
        found = search(source, seek)
        stop, after = found.span() if found else (end, end)
        if stop > at:
            text = source[at:stop]
            pieces.append(html.unescape(text) if "&" in text else text)
        if found is None:
            break
        at = seek = after
        if after - stop > KNOWN_LENGTH:
            kind = _tag(found)
        else:
            key = source[stop:after]
            try:
                kind = _known[key]
            except KeyError:
                if len(_known) >= KNOWN_TAGS:
                    _known.clear()
                kind = _known[key] = _tag(found)
        if kind is None:
            continue
        name = kind.name
        if kind.closes:
            top = node
            while top is not None and top.kind.name != name:
                top = top.parent
            if top is not None:
                here = len(pieces)
                while node is not top:
                    node.end = here
                    node = node.parent
                top.end = here
                node = top.parent
            continue
        if kind.raw:
            close = re.compile(rf"</{name}\b", re.I).search(source, at)
            seek = close.start() if close else end
        here = len(pieces)
        if kind.self_ending and node is not None and node.kind.name == name:
            node.end = here
            node = node.parent
        if node is not None:
            before = node.last
            new = node.last = Element(page, kind, node, before, here)
        else:
            before = last
            new = last = Element(page, kind, None, before, here)
        if before is not None:
            before.after = new
        elements.append(new)
        if not kind.void:
            node = new
    while node is not None:
        node.end = len(pieces)
        node = node.parent
    return page
