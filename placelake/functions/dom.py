"""A tree of HTML elements and a small engine of CSS selectors, for executors."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = ("script", "style", "template")

_SIMPLE = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*|\*)"
    r"|\.(?P<klass>[\w-]+)|#(?P<id>[\w-]+)"
    r"|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<how>[*^$]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\]\"']*)))?\s*\]"
    r"|:(?P<pseudo>first-child|nth-child|contains)(?:\(\s*(?:\"(?P<a1>[^\"]*)\"|'(?P<a2>[^']*)'|(?P<a3>[^)]*))\s*\))?"
)
Test = Callable[["Element"], bool]


class Element:
    """A tag with its attributes; ``index`` is its place among its parent's elements, from 1."""

    __slots__ = ("tag", "attrs", "parent", "children", "index", "n_elements")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.index = self.n_elements = 0
        if parent is not None:
            parent.n_elements += 1
            self.index = parent.n_elements
            parent.children.append(self)

    def _strings(self) -> Iterator[str]:
        """The visible strings in order, with a line break at both ends of each block."""
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag in BLOCKS:
                yield "\n"
                stack.append("\n")
                stack += reversed(x.children)
            elif x.tag not in HIDDEN:
                stack += reversed(x.children)

    def text(self) -> str:
        """The visible text on one line; blocks don't part words."""
        return " ".join("".join(s for s in self._strings() if s != "\n").split())

    def lines(self) -> str:
        """The visible text with a line for each block that has some."""
        lines = (" ".join(line.split()) for line in "".join(self._strings()).split("\n"))
        return "\n".join(line for line in lines if line)

    def all(self) -> Iterator[Element]:
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in reversed(x.children) if isinstance(c, Element)]

    def next_element(self) -> Element | None:
        siblings = (c for c in self.parent.children if isinstance(c, Element)) if self.parent else ()
        return next((c for c in siblings if c.index == self.index + 1), None)


# What a start tag closes, in turn: tags, and the elements that shield them.
_P_ENDS = BLOCKS - {"p", "br"}
_BLOCK_ENDS = ((("p",), _P_ENDS),)
_ENDS = {
    "li": ((("p",), _P_ENDS), (("li",), ("ul", "ol", "table"))),
    "dt": ((("p",), _P_ENDS), (("dt", "dd"), ("dl", "table"))),
    "dd": ((("p",), _P_ENDS), (("dt", "dd"), ("dl", "table"))),
    "td": ((("td", "th"), ("tr", "table")),),
    "th": ((("td", "th"), ("tr", "table")),),
    "tr": ((("tr",), ("table",)),),
    "option": ((("option",), ("select",)),),
}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def _end(self, tags: tuple[str, ...], within: tuple[str, ...] | frozenset[str]) -> None:
        """Close the nearest open element of ``tags``, looking up no further than an element of ``within``."""
        x = self.at
        while x is not self.root and x.tag not in tags and x.tag not in within:
            x = x.parent
        if x.tag in tags:
            self.at = x.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for ended, within in _ENDS.get(tag) or _BLOCK_ENDS if tag in BLOCKS and tag != "br" else _ENDS.get(tag, ()):
            self._end(ended, within)
        x = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.at = x

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _test(m: re.Match) -> Test:
    """The test of one simple selector."""
    if m["tag"]:
        return (lambda x: True) if m["tag"] == "*" else lambda x, tag=m["tag"].lower(): x.tag == tag
    if m["klass"]:
        return lambda x, name=m["klass"]: name in x.attrs.get("class", "").split()
    if m["id"]:
        return lambda x, name=m["id"]: x.attrs.get("id") == name
    if m["attr"]:
        name, value = m["attr"].lower(), m["v1"] or m["v2"] or m["v3"] or ""
        match m["how"]:
            case None:
                return lambda x: name in x.attrs
            case "=":
                return lambda x: x.attrs.get(name) == value
            case "*=":
                return lambda x: value in x.attrs.get(name, "")
            case "^=":
                return lambda x: x.attrs.get(name, "").startswith(value)
            case _:
                return lambda x: x.attrs.get(name, "").endswith(value)
    argument = m["a1"] or m["a2"] or m["a3"] or ""
    if m["pseudo"] == "contains":
        return lambda x: argument in x.text()
    place = 1 if m["pseudo"] == "first-child" else int(argument)
    return lambda x: x.index == place


@functools.lru_cache(maxsize=1024)
def compile_selector(selector: str) -> tuple[tuple[tuple[Test, ...], ...], ...]:
    """Ways of a selector list, each a row of steps by descent, each step a row of tests."""
    ways: list[list[list[Test]]] = [[[]]]
    at = 0
    text = selector.strip()
    while at < len(text):
        if gap := re.compile(r"\s*,\s*").match(text, at):
            ways.append([[]])
        elif gap := re.compile(r"\s+").match(text, at):
            ways[-1].append([])
        elif gap := _SIMPLE.match(text, at):
            ways[-1][-1].append(_test(gap))
        else:
            raise ValueError(f"selector {selector!r} isn't supported")
        at = gap.end()
    return tuple(tuple(tuple(step) for step in way) for way in ways if any(way))


def select(root: Element, selector: str) -> list[Element]:
    """Elements under ``root`` in the order of the document: tag, .class, #id, [attribute] tests,
    :first-child, :nth-child(n), :contains("text"), descent and lists. Ancestors may lie above ``root``."""
    ways = compile_selector(selector)

    def reaches(x: Element, way: tuple[tuple[Test, ...], ...]) -> bool:
        if not all(test(x) for test in way[-1]):
            return False
        left, up = len(way) - 1, x.parent
        while left and up is not None:
            if up.tag and all(test(up) for test in way[left - 1]):
                left -= 1
            up = up.parent
        return not left

    return [x for x in root.all() if any(reaches(x, way) for way in ways)]


def select_first(root: Element, selector: str) -> Element | None:
    return next(iter(select(root, selector)), None)
