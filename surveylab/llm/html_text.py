"""Layout-aware text of HTML pages: all visible text, with block spacing, lists and aligned table cells.

A tokenizer and a stack of open elements give the tree's enter, text and exit
events, with the end tags that HTML implies (a paragraph ends at a block, a
list item at the next one, a cell at the next cell, the head at the first thing
that belongs to the body). The renderer follows
visibility rules (``hidden``, ``display:none``, closed details, scripts and the
like give nothing), collapses white space, puts headings and paragraphs apart
by an empty line and other blocks by a new line, marks and indents list items,
and lays table cells out in columns. Nothing is recursive; a page of any depth
and any broken mark-up gives a result in time linear in its size.

Null and empty pages give an empty text. Repeated rows are rendered each by
itself.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField

from surveylab.llm import common

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
NEVER_SHOWN = frozenset(
    "head script style template noscript iframe noembed noframes title datalist audio video canvas object".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body center details dd dialog dir div dt figcaption footer form header hgroup hr html legend "
    "li main menu nav optgroup option search section summary caption thead tbody tfoot tr td th".split())
LISTS = frozenset("ul ol menu dir".split())
#: An element that begins ends these open ones, up to the nearest one of the second set.
IMPLIED_END = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    **{s: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"]))
       for s in ("thead", "tbody", "tfoot")},
}
#: Elements that leave the head open; all others, and text, end it. What stands in a template there does not, not even
#: <body>, which HTML ignores there.
HEAD_PARTS = frozenset("base link meta title style script noscript template".split())
#: End tags inside of these do not close elements outside of them.
SCOPE = frozenset(["table", "td", "th", "caption", "html"])

#: Lines longer than this do not widen their table column.
WIDEST_CELL = 60
MOST_SPAN = 1000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)\s*(?:(=)\s*)?""")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


def _tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag whose name ends at ``at``, and the place after its ``>`` (-1: it never ends)."""
    attributes: dict[str, str] = {}
    size = len(page)
    while True:
        m = _ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return attributes, end + 1 if end >= 0 else -1
        name, at = m[1].lower(), m.end()
        value = ""
        if m[2]:
            if at >= size:
                return attributes, -1
            if page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return attributes, -1
                value, at = page[at + 1:end], end + 1
            else:
                m = _UNQUOTED.match(page, at)
                value, at = m[0], m.end()
        attributes.setdefault(name, value)


def tokens(page: str) -> Iterator[tuple[str, str, dict | None]]:
    """('text', text, None), ('start', name, attributes) and ('end', name, None) of a page."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], None
            return
        if lt > at:
            yield "text", page[at:lt], None
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            comment = page.startswith("<!--", lt)
            if comment and page.startswith(">", lt + 4):
                at = lt + 5
                continue
            end = page.find("-->" if comment else ">", lt + (4 if comment else 2))
            if end < 0:
                return
            at = end + (3 if comment else 1)
        elif nxt == "/":
            m = _NAME.match(page, lt + 2)
            end = page.find(">", lt + 2)
            if end < 0:
                return
            if m:
                yield "end", m[0].lower(), None
            at = end + 1
        elif m := _NAME.match(page, lt + 1):
            name = m[0].lower()
            attributes, at = _tag(page, m.end())
            if at < 0:
                return
            yield "start", name, attributes
            if name in RAW:
                m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                yield "raw", page[at:m.start() if m else size], None
                at = m.start() if m else size
        else:
            yield "text", "<", None
            at = lt + 1


def events(page: str) -> Iterator[tuple[str, str, dict | None]]:
    """Enter, text, raw and exit events of the tree; every entered element is exited."""
    open_: list[str] = []
    count: dict[str, int] = {}

    def leave_upto(k: int):
        while len(open_) > k:
            name = open_.pop()
            count[name] -= 1
            yield "exit", name, None

    for kind, name, attributes in tokens(page):
        if kind == "start":
            if open_ and open_[-1] == "head" and name not in HEAD_PARTS:
                yield from leave_upto(len(open_) - 1)
            ends = IMPLIED_END.get(name)
            if ends and any(count.get(n) for n in ends[0]):
                k = found = len(open_)
                while k and open_[k - 1] not in ends[1]:
                    k -= 1
                    if open_[k] in ends[0]:
                        found = k
                yield from leave_upto(found)
            elif name in BLOCK and count.get("p"):
                k = len(open_)
                while k and open_[k - 1] not in SCOPE and open_[k - 1] != "p":
                    k -= 1
                if k and open_[k - 1] == "p":
                    yield from leave_upto(k - 1)
            yield "enter", name, attributes
            if name in VOID:
                yield "exit", name, None
            else:
                open_.append(name)
                count[name] = count.get(name, 0) + 1
        elif kind == "end":
            if name == "br":
                yield "enter", "br", {}
                yield "exit", "br", None
            elif count.get(name):
                k = len(open_)
                while open_[k - 1] != name and (open_[k - 1] not in SCOPE or name in SCOPE or name in IMPLIED_END):
                    k -= 1
                if open_[k - 1] == name:
                    yield from leave_upto(k - 1)
        else:
            if kind == "text" and open_ and open_[-1] == "head" and html.unescape(name).strip(" \t\n\r\f"):
                yield from leave_upto(len(open_) - 1)
            yield kind, name, None
    yield from leave_upto(0)


class _Lines:
    """Text laid out in lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0      # 1: a new line, 2: an empty line comes before the next text
        self.space = False
        self.indents: list[int] = []
        self.mark = ""    # of a list item, before its first text

    def _begin(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        width = sum(self.indents)
        self.line.append(" " * (width - len(self.mark)) + self.mark)
        self.mark = ""

    def add(self, text: str) -> None:
        if not self.line:
            self._begin()
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def part(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def flow(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        inner = text.strip(" ")
        if not inner:
            self.space = self.space or bool(text and self.line)
            return
        if text[0] == " " and self.line:
            self.space = True
        self.add(inner)
        self.space = text[-1] == " "

    def kept(self, text: str) -> None:
        """Text whose white space stays."""
        rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, row in enumerate(rows):
            if i:
                if self.line:
                    self.end_line()
                elif self.lines and not self.gap:
                    self.lines.append("")
            if row:
                self.add(row)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Table:
    """Cells by row; cells that span rows keep their columns in the rows below."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.below: dict[int, int] = {}  # column: rows below that it is taken in
        self.column = 0

    def row(self) -> None:
        if self.rows:
            self.below = {c: n - 1 for c, n in self.below.items() if n > 1}
        self.rows.append([])
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.below.get(self.column):
            self.column += 1
        self.rows[-1].append((self.column, across, lines))
        if down > 1:
            for c in range(self.column, self.column + across):
                self.below[c] = max(self.below.get(c, 0), down)
        self.column += across

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, across, lines in row:
                if across == 1:
                    fits = [w for w in map(_width, lines) if w <= WIDEST_CELL]
                    width[c] = max(width.get(c, 0), max(fits, default=0))
        # Columns that no row has text in take no place.
        used = sorted({c for row in self.rows for c, _, lines in row if lines})
        starts = [0, *accumulate(width.get(c, 0) + 2 for c in used)]
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line, end = [], 0
                for c, _, lines in row:
                    start = starts[bisect_left(used, c)]
                    text = lines[k] if k < len(lines) else ""
                    if not text:
                        continue
                    pad = max(start - end, 2 if line else 0)
                    line.append(" " * pad + text)
                    end += pad + _width(text)
                out.append("".join(line))
        return out


def _number(value: str | None, least: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return max(least, min(int(m[1]), most)) if m else least


def render(page: str) -> str:
    """The visible text of a page."""
    out = [_Lines()]
    tables: list[_Table] = []
    spans: list[tuple[int, int]] = []
    lists: list[list] = []      # [numbered, next number]
    hidden = kept = 0           # depth inside hidden and inside preformatted elements
    closed: list[list] = []     # details that are closed: [depth of its children, inside its summary]
    depth = 0
    for kind, name, attributes in events(page):
        if kind == "enter":
            depth += 1
            if hidden:
                hidden += 1
                continue
            if closed and not closed[-1][1]:
                if name != "summary" or depth != closed[-1][0] + 1:
                    hidden = 1
                    continue
                closed[-1][1] = True
            if (name in NEVER_SHOWN or "hidden" in attributes or _HIDING.search(attributes.get("style", ""))
                    or name == "dialog" and "open" not in attributes):
                hidden = 1
                continue
            here = out[-1]
            if name == "details" and "open" not in attributes:
                closed.append([depth, False])
            if name == "br":
                if here.line or here.mark:
                    here.end_line()
                    here.gap = max(here.gap, 1)
                else:
                    here.gap = 2 if here.lines else 0
            elif name in ("td", "th"):
                if tables:
                    spans.append((_number(attributes.get("colspan"), 1, MOST_SPAN),
                                  _number(attributes.get("rowspan"), 1, 1 << 16)))
                    out.append(_Lines())
                else:
                    here.part(1)
                    spans.append((0, 0))
            elif name in BLOCK:
                here.part(2 if name in SPACED and not (name in LISTS and lists) else 1)
            if name == "table":
                tables.append(_Table())
            elif name == "tr" and tables:
                tables[-1].row()
            elif name in LISTS:
                lists.append([name == "ol", _number(attributes.get("start"), -(1 << 30), 1 << 30)
                              if "start" in attributes else 1])
            elif name == "li":
                if lists and lists[-1][0]:
                    number = _number(attributes["value"], -(1 << 30), 1 << 30) if "value" in attributes else lists[-1][1]
                    lists[-1][1] = number + 1
                    here.mark = f"{number}. "
                else:
                    here.mark = "- "
                here.indents.append(len(here.mark))
            elif name in ("dd", "blockquote"):
                here.indents.append(2)
            elif name in ("pre", "textarea", "xmp", "listing"):
                kept += 1
        elif kind == "exit":
            depth -= 1
            if hidden:
                hidden -= 1
                continue
            here = out[-1]
            if name in ("td", "th"):
                across, down = spans.pop()
                if across:
                    here.end_line()
                    out.pop()
                    tables[-1].cell(here.lines, across, down)
                else:
                    here.part(1)
            elif name in BLOCK and name != "br":
                here.part(2 if name in SPACED and not (name in LISTS and len(lists) > 1) else 1)
            if name == "table":
                for line in tables.pop().lines():
                    if line:
                        here.add(line)
                        here.end_line()
                here.part(2)
            elif name in LISTS:
                lists.pop()
            elif name in ("li", "dd", "blockquote"):
                here.indents.pop()
                here.mark = "" if name == "li" else here.mark
            elif name in ("pre", "textarea", "xmp", "listing"):
                kept -= 1
            if name == "summary" and closed and depth == closed[-1][0]:
                closed[-1][1] = False
            if name == "details" and closed and depth == closed[-1][0] - 1:
                closed.pop()
        elif not hidden and not (closed and not closed[-1][1]):
            (out[-1].kept if kept else out[-1].flow)(html.unescape(name))
    out[0].end_line()
    return "\n".join(out[0].lines)


def extract(df: DataFrame, source: str = "html", text: str = "text", keep=None) -> DataFrame:
    """Append ``text``: the visible text of each whole page."""
    def task():
        return lambda col: [pa.array([render(x) for x in common.texts(col)], pa.string())]

    return common.map_columns(df, [source], [StructField(text, StringType())], task, keep)
