"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned tables.

The tree builder closes elements that HTML lets one leave open and opens those that it implies; the
visibility rules drop what a browser doesn't show. Rendering walks the tree without recursion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe object audio video canvas".split())
#: Elements whose children may be closed by a slash, and what isn't shown inside them.
FOREIGN = {"svg": frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()), "math": frozenset("annotation annotation-xml".split())}
#: Where HTML goes on inside them.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address li dt dd tr caption thead tbody tfoot figcaption details summary legend option center".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
#: What an opening tag closes, up to the elements that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
WIDEST_CELL = 60
"""Wider cells don't widen their column."""
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "lines", "tag", "unseen")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.lines: list[str] = []  # of a table, rendered
        self.unseen = False  # by where it stands

    def visible(self) -> bool:
        if self.unseen or self.tag in UNSEEN or "hidden" in self.attrs:
            return False
        if self.tag == "input" and (self.attrs.get("type") or "").lower() == "hidden":
            return False
        return not _HIDDEN.search(self.attrs.get("style") or "")


class Builder(HTMLParser):
    """Builds a tree of nodes and strings; never fails on malformed input."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # of open elements, so that deep pages aren't searched for what isn't there

    def _cut(self, i: int) -> None:
        self.count.subtract(n.tag for n in self.open[i:])
        del self.open[i:]

    def _close(self, tags: set[str], bounds: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in bounds:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in UNSEEN:
            self._close({"head"}, set())
        if tag in CLOSED_BY_BLOCK:
            self._close({"p"}, {"td", "th", "li", "button", "table", "caption", "object"})
        if tag in CLOSES:
            inner, outer = CLOSES[tag]
            while True:
                before = len(self.open)
                self._close(inner, outer)
                if len(self.open) == before:
                    break
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, dict(attrs))
        node.unseen = any(self.count[t] and tag in hidden for t, hidden in FOREIGN.items())
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def _foreign(self) -> str:
        """``svg`` or ``math`` if the next element belongs to one, else ''."""
        if not any(self.count[t] for t in FOREIGN):
            return ""
        for node in reversed(self.open):
            if node.tag in FOREIGN:
                return node.tag
            if node.tag in INTEGRATION:
                return ""
        return ""

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        closed = tag in FOREIGN or bool(self._foreign())
        self.handle_starttag(tag, attrs)
        if closed and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if not self.count[tag]:
            if tag == "p":
                self.open[-1].children.append(Node("p", {}))
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._close({"head"}, set())
        self.open[-1].children.append(data)


class _Flow:
    """Text in lines, with the breaks between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.lead = "", 0, False, ""
        self.prefix: list[str] = []

    def text(self, s: str) -> None:
        for k, word in enumerate(_SPACE.split(s)):
            if k:
                self.space = True
            if word:
                self._start()
                self.line += (" " if self.space and self.line else "") + word
                self.space = False

    def _start(self) -> None:
        if not self.line and self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0 if not self.line else self.gap

    def pre(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.end(1, True)
            if part:
                self._start()
                self.line += part

    def end(self, gap: int, empty: bool = False) -> None:
        """End the line; the next text stands ``gap - 1`` empty lines below."""
        if self.line or empty:
            self.lines.append(("".join(self.prefix) + self.lead + self.line).rstrip())
            if self.lead:
                self.lead = ""
            self.line, self.gap = "", 0
        self.space, self.gap = False, max(self.gap, gap)


def render(html: str | None) -> str:
    """The visible text of a page: '' for null, empty and invisible ones."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    for table in reversed(_tables(builder.root)):  # inner tables first
        table.lines = table_lines(table)
    return _render(builder.root)


def _tables(root: Node) -> list[Node]:
    """All tables of a tree, outer ones before those inside."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "table":
            found.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    return found


def _render(root: Node) -> str:
    flow = _Flow()
    # entries: a node or string to render, or a function to call after the children
    stack: list = [(root, False)]
    depth, numbers = [0], []
    while stack:
        item, pre = stack.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            flow.pre(item) if pre else flow.text(item)
            continue
        if not item.visible():
            continue
        tag = item.tag
        if tag == "br":
            flow.end(1, True)
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "input":
            if (item.attrs.get("type") or "").lower() in ("submit", "button", "reset") and item.attrs.get("value"):
                flow.text(f" {item.attrs['value']} ")
            continue
        if tag == "table":
            flow.end(2)
            for line in item.lines:
                flow.line = line
                flow._start()
                flow.end(1)
            flow.end(2)
            continue
        if tag in BLOCK:
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and depth[0]) else 1
            flow.end(gap)
            if tag in ("ul", "ol"):
                depth[0] += 1
                start = item.attrs.get("start") or "1"
                numbers.append([tag, int(start) if start.lstrip("-").isdecimal() else 1])

                def leave(gap: int = gap) -> None:
                    flow.end(gap)
                    depth[0] -= 1
                    numbers.pop()

                stack.append((leave, False))
            elif tag == "li":
                mark = "- "
                if numbers and numbers[-1][0] == "ol":
                    mark = f"{numbers[-1][1]}. "
                    numbers[-1][1] += 1
                flow.lead = "  " * max(0, depth[0] - 1) + mark

                def close(lead: str = flow.lead) -> None:
                    flow.end(1)
                    if flow.lead == lead:
                        flow.lead = ""

                stack.append((close, False))
            else:
                stack.append((lambda gap=gap: flow.end(gap), False))
        inner = pre or tag in ("pre", "textarea")
        stack += [(c, inner) for c in reversed(item.children)]
    flow.end(0)
    return "\n".join(flow.lines).strip("\n")


def table_lines(table: Node) -> list[str]:
    """A table's rows as lines, cells padded to their columns; a cell's own lines are joined by spaces. Tables inside have their lines already."""
    rows: list[list[str]] = []
    captions: list[str] = []
    stack = list(reversed(table.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                captions.append(" ".join(item.split()))
        elif not item.visible():
            continue
        elif item.tag == "tr":
            cells = []
            for cell in item.children:
                if isinstance(cell, Node) and cell.visible() and cell.tag in ("td", "th"):
                    cells.append(" ".join(_render(_plain(cell)).split()))
                    span = cell.attrs.get("colspan") or "1"
                    cells += [""] * (min(int(span), 1000) - 1 if span.isdecimal() else 0)
                elif isinstance(cell, Node) and cell.visible():
                    captions.append(" ".join(_render(_plain(cell)).split()))
                elif isinstance(cell, str) and cell.strip():
                    captions.append(" ".join(cell.split()))
            rows.append(cells)
        elif item.tag in ("tbody", "thead", "tfoot"):
            stack += reversed(item.children)
        else:
            captions.append(" ".join(_render(_plain(item)).split()))
    width: list[int] = []
    for cells in rows:
        for i, c in enumerate(cells):
            if i == len(width):
                width.append(0)
            if len(c) <= WIDEST_CELL:
                width[i] = max(width[i], len(c))
    lines = [c for c in captions if c]
    return lines + [line for cells in rows if (line := "  ".join(c.ljust(width[i]) for i, c in enumerate(cells)).rstrip())]


def _plain(node: Node) -> Node:
    """The content of a cell as a tree of its own."""
    out = Node("div", {})
    out.children = node.children
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([render(x) for x in batch.column("html").to_pylist()], pa.string())], ["row", "text"])


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Render every page: ``row`` (struct of the columns ``carry``), text, n_chars and n_lines.

    ``pages`` needs html. Null, empty and wholly invisible pages have an empty text; repeated rows are
    rendered alike; pages of any length and depth are rendered whole.
    """
    row = F.struct(*carry).alias("row")
    kind = pages.select(row).schema["row"].dataType.simpleString()
    out = pages.select(row, "html").mapInArrow(_pages, f"row {kind}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("row", "text", F.char_length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
