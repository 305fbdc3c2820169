"""HTML to text as a page lays it out.

A tokenizer feeds a stack of open elements that supplies implied tags (a block ends an open paragraph, a list item the one
before it, a cell or row its neighbours, the body the head). What is not shown (scripts, styles, heads, templates, hidden
elements) is left out; all other text is kept. Blocks stand on lines of their own, paragraphs and headings between blank lines,
list items behind a dash or number at the depth of their list, preformatted text as it is, and table cells
in aligned columns over as many columns and rows as they span, with blocks and lists inside a cell on lines of their own. Elements are
handled as they come, without recursion, and open elements are looked up by name, so nesting may be of any depth; spans are ranges, quotes
that never close are followed once, and tables more than ``DEEPEST`` deep are read as blocks, so the work follows the length of the page
(times at most ``DEEPEST`` for nested tables and the 1,000 rows that a cell may span). Closed ``details`` are shown, closed dialogs are not; what is visible within a hidden visibility is shown.

Rows are independent: one scan, no shuffle, pages in slices of about 1 MB. Edge cases: null html gives null text, empty html empty text;
a page of any length is one row; markup that never closes is text up to its end; bytes of a cut-off tag at the end are dropped; repeated rows
give equal texts; an empty table gives an empty result; extra columns are kept, one named like the result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.storage import ship

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: What follows a tag's name: quoted values and all else up to the end of the tag, never given back.
_REST = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
SLICE_CHARS = 1 << 20

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul h1 h2 h3 h4 h5 h6 caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
HEAD_ONLY = frozenset("base link meta script style title template noscript head html".split())
#: An opening tag ends open elements of these names, up to a boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption"}
#: End tags do not reach past these.
WALLS = frozenset({"table", "td", "th", "caption", "body", "html"})


class _Flow:
    """Text under layout: collapsed spaces, pending line breaks, prefixes of list items."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.breaks, self.space, self.mark, self.indent = 0, False, "", 0

    def line(self, n: int = 1) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def _open(self) -> None:
        if self.breaks:
            if self.out:
                self.out.append("\n" * self.breaks)
            self.breaks = 0
            self.out.append("  " * self.indent)
        if self.mark:
            self.out.append(self.mark)
            self.mark = ""

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " ":
            self.space = True
            return
        body = words.strip(" ")
        if not body:
            return
        fresh = self.breaks or not self.out or bool(self.mark)
        self._open()
        if (self.space or words[0] == " ") and not fresh:
            self.out.append(" ")
        self.out.append(body)
        self.space = words[-1] == " "

    def verbatim(self, text: str) -> None:
        if text:
            self._open()
            self.out.append(text)
            self.space = False

    def result(self) -> str:
        return "\n".join(line.rstrip(" \t") for line in "".join(self.out).split("\n")).strip("\n")


#: Tables of longer lines are not aligned: cells stand two spaces apart.
WIDEST = 1024
#: Tables within so many others are read as blocks, so that no text is laid out again and again.
DEEPEST = 32


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> str:
    """Rows of (lines, columns, rows that the cell spans) with the columns of equal width, two spaces apart.

    Spans are ranges, and only columns where a cell begins take room.
    """
    placed: list[list[tuple[int, list[str]]]] = []
    covered: list[tuple[int, int, int]] = []  # (first column, end, row from which they are free), by first column
    width: dict[int, int] = {}
    for r, row in enumerate(rows):
        covered = [c for c in covered if c[2] > r]
        at, k, line, below = 0, 0, [], []
        for lines, span, down in row:
            while k < len(covered) and covered[k][0] <= at:
                at = max(at, covered[k][1])
                k += 1
            line.append((at, lines))
            width[at] = max([width.get(at, 0), *map(len, lines if span == 1 else ())])
            if down > 1:
                if below and below[-1][1:] == (at, r + down):
                    below[-1] = (below[-1][0], at + span, r + down)
                else:
                    below.append((at, at + span, r + down))
            at += span
        placed.append(line)
        if below:
            covered = sorted(covered + below)
    starts, total = {}, 0
    for c in sorted(width):
        starts[c] = total
        total += width[c] + 2
    out = []
    for line in placed:
        for k in range(max((len(lines) for _, lines in line), default=0)):
            text = ""
            for at, lines in line:
                if k < len(lines) and lines[k]:
                    fits = total <= WIDEST and (not text or len(text) + 2 <= starts[at])
                    text = text.ljust(starts[at]) if fits else text + "  " if text else ""
                    text += lines[k]
            out.append(text.rstrip())
    return "\n".join(line for line in out if line)


class _Quotes:
    """Where the tags of a page with a quote that never closes end: every quote is followed once, whatever number of tags run into it."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.marks = [m.start() for m in re.finditer("['\">]", html)]
        self.same = {q: [i for i in self.marks if html[i] == q] for q in "'\""}
        self.ends: dict[int, int | None] = {}

    def end(self, at: int) -> int | None:
        """The place of the ``>`` that ends a tag whose name ends at ``at``, the page's end if nothing follows, None if a quote stays open."""
        passed: list[int] = []
        while True:
            k = bisect_left(self.marks, at)
            if k == len(self.marks):
                found = len(self.html)
                break
            mark = self.marks[k]
            if self.html[mark] == ">":
                found = mark
                break
            if mark in self.ends:
                found = self.ends[mark]
                break
            passed.append(mark)
            same = self.same[self.html[mark]]
            k = bisect_right(same, mark)
            if k == len(same):
                found = None
                break
            at = same[k] + 1
        self.ends.update(dict.fromkeys(passed, found))
        return found


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


def _hidden(name: str, attributes: dict[str, str]) -> bool:
    if "hidden" in attributes or attributes.get("type", "").lower() == "hidden":
        return True
    return name == "dialog" and "open" not in attributes or bool(_NO_DISPLAY.search(attributes.get("style", "")))


class _Page:
    def __init__(self) -> None:
        self.flow = _Flow()
        self.open: list[tuple[str, bool, bool]] = []  # (name, hides its content, whether text around it is invisible)
        self.deep = 0  # open tables that are read as blocks
        self.at: dict[str, list[int]] = {}  # name -> places in the stack
        self.flows: list[tuple[_Flow, list[int | None]]] = []  # flow and lists around open cells
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.spans: list[tuple[int, int]] = []
        self.lists: list[int | None] = []  # next number, or None for dashes
        self.dark = self.pre = 0
        self.invisible = False

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS:
            names, walls = ENDS[name]
            wall = self.last(walls)
            inside = [places[k] for n in names if (places := self.at.get(n)) and (k := bisect_right(places, wall)) < len(places)]
            if inside:
                self.close_to(min(inside))
        if name in ENDS_P and self.at.get("p"):
            self.end("p")
        if name not in HEAD_ONLY and any(e[0] == "head" for e in self.open[:3]):
            self.end("head")
        found = _attributes(attributes) if attributes else {}
        hides = name in UNSEEN or _hidden(name, found)
        if name == "br" and not self.dark:
            self.flow.breaks, self.flow.space = min(self.flow.breaks + 1, 2), False
        if name in BLOCK and not self.dark:
            self.flow.line(2 if name in SPACED and not (self.lists and name in ("ul", "ol")) else 1)
        if name in VOID:
            return
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, hides, self.invisible))
        if found and (visibility := _VISIBILITY.search(found.get("style", ""))):
            self.invisible = visibility[1].lower() != "visible"
        self.dark += hides
        self.pre += name in ("pre", "textarea")
        if self.dark:
            return
        if name in ("ul", "ol", "menu", "dir"):
            number = found.get("start", "1")
            self.lists.append((int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1) if name == "ol" else None)
            self.flow.indent = len(self.lists) - 1
        elif name == "li":
            number = self.lists[-1] if self.lists else None
            self.flow.mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif name == "table" and (self.deep or len(self.tables) >= DEEPEST):
            self.deep += 1
        elif self.deep and name in ("tr", "td", "th"):
            self.flow.line() if name == "tr" else self.flow.text(" ")
        elif name == "table":
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            spans = (found.get(k, "1") for k in ("colspan", "rowspan"))
            self.spans.append(tuple(min(max(int(x), 1), 1000) if x.isdecimal() and x.isascii() and len(x) < 6 else 1 for x in spans))
            self.flows.append((self.flow, self.lists))
            self.flow, self.lists = _Flow(), []

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            name, hides, self.invisible = self.open.pop()
            self.at[name].pop()
            shown = not self.dark
            self.dark -= hides
            self.pre -= name in ("pre", "textarea")
            if not shown:
                continue
            if self.deep and name in ("table", "tr", "td", "th"):
                self.deep -= name == "table"
            elif name in ("td", "th") and self.spans and self.tables:
                lines = [line for line in self.flow.result().split("\n") if line]
                self.flow, self.lists = self.flows.pop()
                self.tables[-1][-1].append((lines, *self.spans.pop()))
            elif name == "table" and self.tables:
                text = _aligned(self.tables.pop())
                self.flow.line(2)
                for line in text.split("\n"):
                    self.flow.verbatim(line)
                    self.flow.line()
            elif name in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
                self.flow.indent = max(len(self.lists) - 1, 0)
                self.flow.mark = ""
            if name in BLOCK:
                self.flow.line(2 if name in SPACED and not (self.lists and name in ("ul", "ol")) else 1)

    def end(self, name: str) -> None:
        at = self.last((name,))
        if at >= 0 and (name in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") or self.last(WALLS - {name}) < at):
            self.close_to(at)

    def text(self, text: str) -> None:
        if self.dark or self.invisible or not text:
            return
        text = unescape(text) if "&" in text else text
        if self.pre:
            self.flow.verbatim(text)
        else:
            self.flow.text(text)


def html_to_text(html: str) -> str:
    """The visible text of a page, laid out."""
    page, at = _Page(), 0
    for_raw = quotes = None
    while at < len(html):
        if for_raw is not None:
            found = re.compile(rf"</{re.escape(for_raw)}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = found.start() if found else len(html)
            if for_raw in ("textarea", "xmp"):
                page.text(html[at:stop])
            at, for_raw = stop, None
            continue
        look = at
        while found := _OPEN.search(html, look):
            stop = found.end()
            if found[2] is None:
                break
            stop = _REST.match(html, stop).end() if quotes is None else quotes.end(stop)
            if quotes is None and stop < len(html) and html[stop] != ">":
                quotes = _Quotes(html)
                stop = quotes.end(found.end())
            if stop is not None:
                break
            look = found.start() + 1  # a quote stays open: no tag, its text stays
        if not found:
            page.text(html[at:])
            break
        page.text(html[at : found.start()])
        rest, at = html[found.end() : stop], min(stop + (found[2] is not None), len(html))
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            page.end(name)
        else:
            page.start(name, rest)
            if name in RAW and page.open and page.open[-1][0] == name:
                for_raw = name
    page.close_to(0)
    return page.flow.result()


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without its html and with ``text_col``."""
    ship(pages.sparkSession)
    others = [c for c in pages.columns if c != html_col and c.lower() != text_col.lower()]
    rows = pages.select(*[f"`{c}`" for c in others], f"`{html_col}`")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, first = [], 0, 0
            for i, value in enumerate(batch.column(len(others))):
                html = value.as_py()
                texts.append(None if html is None else html_to_text(html))
                size += len(html or "")
                if size >= SLICE_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns[: len(others)], pa.array(texts, pa.string())], names=schema.names)
                    texts, size, first = [], 0, i + 1

    return rows.mapInArrow(run, schema)
