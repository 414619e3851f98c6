"""Operator 8: visible text of HTML pages, laid out.

``parse`` builds the element tree, with void elements, raw-text elements and
implied end tags (a paragraph ends where a block starts, a list item where the
next one starts, cells and rows likewise, the head where anything comes that may
not stand in it).  ``render`` walks the tree and emits
what a reader would see: blocks on lines of their own, an empty line around
paragraphs, headings, lists and tables, list marks with their indentation,
preformatted text as it is, and the cells of a table in aligned columns: a
cell's lines stand below each other, and a cell over several rows holds its
column in them.  Elements that are never shown, and those hidden by attribute or
inline style, are left out with all they hold; what is hidden from screen
readers alone is shown.

Both parts work with stacks of their own, so deeply nested pages need no
recursion, and take time in proportion to the page: where each tag was opened
last is kept, so no end tag walks the stack, and a start tag that never ends is
looked for once.  From ``MAX_INDENT`` levels on lists are not indented further, tables
inside ``MAX_TABLES`` others are plain lines, and columns start ``MAX_CELL`` characters after the one before at most.  A null or empty page gives an empty text; broken markup is read as
far as it makes sense; repeated rows are rendered alike; other columns are kept
out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import ship

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe object audio video svg math datalist meta link "
                   "noembed noframes canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset("address article aside body caption dd details dialog div dt fieldset figcaption footer form "
                           "header html legend li main menu nav section summary tr thead tbody tfoot option".split())
ENDS_P = BLOCK - frozenset("option tr thead tbody tfoot caption html body".split())

# a start tag ends these open elements, looked for down to the elements that hold them
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
    **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
}
STOPS_P = frozenset("table td th caption button object".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template html head".split())

MAX_INDENT, MAX_TABLES, MAX_CELL, MAX_SPAN = 10, 10, 200, 100
#: A comment, a declaration, an end tag, or the name of a start tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)", re.S)
_QUOTE_OR_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"(display\s*:\s*none|visibility\s*:\s*(hidden|collapse))", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and texts


def _tag_end(page: str, at: int) -> int:
    """Where a start tag's ``>`` stands, or -1: the next one outside quotes; quotes that do not close do not count."""
    first = at
    while (m := _QUOTE_OR_END.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = m.end() if close < 0 else close + 1
    return page.find(">", first)


class _Open:
    """The open elements, and the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost element of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, names, stops) -> None:
        """End the elements of ``names`` inside the innermost one of ``stops``, and all within them."""
        wall = self.last(stops)
        while (place := self.last(names)) > wall:
            self.cut(place)

    def leave_head(self) -> None:
        if self.places.get("head"):
            self.cut(self.places["head"][0])


def parse(page: str) -> Node:
    """The element tree below a nameless root."""
    root = Node("")
    open_, at, n = _Open(root), 0, len(page)
    last_end = page.rfind(">")

    def add_text(text: str) -> None:
        if open_.stack[-1].tag == "head" and _BLANKS.sub("", text):
            open_.leave_head()
        open_.stack[-1].children.append(html.unescape(text))

    begin = 0  # of text that has not been added yet
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        end, start = m.group(1), m.group(2)
        stop = m.end()
        if start:
            if stop > last_end:  # no start tag ends any more: text, up to the next mark of another kind
                at = stop
                continue
            stop = _tag_end(page, stop)
            attributes_text, stop = page[m.end():stop], stop + 1
        if m.start() > begin:
            add_text(page[begin:m.start()])
        at = begin = stop
        if end:
            end = end.lower()
            place = open_.last((end,))
            # an end tag without its start does not leave a cell
            wall = 0 if end in ("table", "tr", "tbody", "thead", "tfoot") else open_.last(("td", "th", "table"))
            if place and place >= wall:
                open_.cut(place)
            continue
        if not start:
            continue
        tag = start.lower()
        if (open_.stack[-1].tag == "head" and tag not in IN_HEAD) or (tag == "body" and not open_.places.get("template")):
            open_.leave_head()
        if tag in ENDS_P:
            open_.close({"p"}, STOPS_P)
        if tag in IMPLIED:
            open_.close(*IMPLIED[tag])
        attributes = {}
        if attributes_text.strip(" /\n\t\r"):
            for a in _ATTRIBUTE.finditer(attributes_text):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        node = Node(tag, attributes)
        open_.stack[-1].children.append(node)
        if tag in VOID or (attributes_text.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at:close.start() if close else n]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = begin = close.end() if close else n
            continue
        open_.push(node)
    if begin < n:
        add_text(page[begin:])
    return root


def hidden(node: Node) -> bool:
    a = node.attributes
    return (node.tag in UNSEEN or "hidden" in a
            or (node.tag == "input" and a.get("type", "").lower() == "hidden") or bool(_HIDDEN.search(a.get("style", ""))))


class _Page:
    """Lines under construction."""

    def __init__(self, width: int = 0):
        self.lines: list[str] = []
        self.pieces: list[str] = []  # of the line, none empty
        self.space = False   # an empty line is due
        self.level = 0       # of indentation
        self.mark = ""       # of a list item that has no text yet

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self._flush(keep=True)
                self._add(line)
            return
        text = _BLANKS.sub(" ", text)
        if not self.pieces or self.pieces[-1].endswith(" "):
            text = text.lstrip(" ")
        self._add(text)

    def _add(self, text: str) -> None:
        if text:
            self.pieces.append(text)

    @property
    def indent(self) -> str:
        return "    " * min(self.level, MAX_INDENT)

    def _flush(self, keep: bool = False) -> None:
        line = "".join(self.pieces)
        self.pieces = []
        if not keep:
            line = line.rstrip(" ")
        if not line and not keep:
            return
        if self.space and self.lines:
            self.lines.append("")
        self.space = False
        if self.mark:
            lead = self.indent[:max(len(self.indent) - len(self.mark), 0)] + self.mark
            self.mark = ""
        else:
            lead = self.indent
        self.lines.append((lead + line).rstrip())

    def end_line(self, spaced: bool) -> None:
        self._flush()
        self.space = self.space or (spaced and bool(self.lines))


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) in aligned columns, two blanks between them."""
    held: dict[int, int] = {}  # column: rows that a cell from above still holds it
    placed, widths = [], []
    for row in rows:
        k, cells, more = 0, [], {}
        for lines, columns, below in row:
            while held.get(k):
                k += 1
            cells.append((k, lines))
            widths += [0] * (k + columns - len(widths))
            if columns == 1:
                widths[k] = max(widths[k], min(max(map(len, lines), default=0), MAX_CELL))
            if below > 1:
                more |= {j: below - 1 for j in range(k, k + columns)}
            k += columns
        held = {j: n - 1 for j, n in held.items() if n > 1} | more
        placed.append(cells)
    begin = [0]
    for width in widths:
        begin.append(min(begin[-1] + width + 2, 10 * MAX_CELL))
    out = []
    for cells in placed:
        for h in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for k, lines in cells:
                if h < len(lines) and lines[h]:
                    line = (line + "  " if len(line) > begin[k] - 2 and line else line).ljust(begin[k]) + lines[h]
            if line.rstrip():
                out.append(line.rstrip())
    return out


def _number(text: str) -> int:
    return min(int(text), MAX_SPAN) if text.isdecimal() and len(text) < 9 and int(text) else 1


def render(root: Node) -> str:
    """The text of all that is visible."""
    pages = [_Page()]                     # one for the page, one for each open cell
    tables: list[list] = []               # rows of each open table
    lists: list[list] = []                # [ordered, number] of each open list
    pre = deep = 0                        # open preformatted elements; tables that are not laid out
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if not tables or len(pages) > 1 or not node.isspace():
                page.text(node, pre > 0)
            continue
        tag = node.tag
        if leaving:
            if tag == "pre":
                pre -= 1
            if tag in ("td", "th") and tables and not deep and len(pages) > 1:
                cell = pages.pop()
                cell.end_line(False)
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell.lines, *[_number(node.attributes.get(x, "1")) for x in ("colspan", "rowspan")]))
                continue
            if tag == "table" and deep:
                deep -= 1
            elif tag == "table":
                for line in _table(tables.pop()):
                    page.pieces = [line]
                    page._flush()
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                page.level -= 1
            if tag in ("dd", "blockquote"):
                page.level -= 1
            if tag in BLOCK and tag != "tr":
                page.end_line(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "li":
                page.mark = ""
            continue
        if hidden(node):
            continue
        if tag == "br":
            page._flush(keep=bool(page.pieces) or pre > 0)
            continue
        if tag == "img":
            if node.attributes.get("alt"):
                page.text(node.attributes["alt"], False)
            continue
        if tag in BLOCK and tag != "tr":
            page.end_line(tag in SPACED and not (tag in ("ul", "ol") and lists))
        if tag == "tr" and deep:
            page.end_line(False)
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th"):
            if tables and not deep:
                pages.append(_Page())
            else:
                page.text(" ", False)
        elif tag == "table" and len(tables) >= MAX_TABLES:
            deep += 1
        elif tag == "table":
            tables.append([])
        elif tag in ("ul", "ol", "menu"):
            begin = node.attributes.get("start", "1")
            lists.append([tag == "ol", int(begin) if begin.isdigit() else 1])
            page.level += 1
        elif tag in ("dd", "blockquote"):
            page.level += 1
        elif tag == "li" and lists:
            ordered, number = lists[-1]
            page.mark = f"{number}. " if ordered else "- "
            lists[-1][1] += 1
        elif tag == "pre":
            pre += 1
        elif tag == "hr":
            continue
        todo.append((node, True))
        todo.extend((child, False) for child in reversed(node.children))
    pages[0].end_line(False)
    return "\n".join(pages[0].lines).strip("\n")


def visible_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (what is visible): one row per page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text = [visible_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(text, pa.string())], ["page_id", "url", "text"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
