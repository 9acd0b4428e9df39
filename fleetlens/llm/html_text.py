"""All visible text of HTML pages, laid out in lines.

A page is read by the tokenizer of the standard library into a tree; start tags that imply the end of an
open element (a paragraph by a block, an item by an item, a cell by a cell or row, ...) close it, and
end tags close what is open inside their element or are ignored.  The tree is then rendered:

* not shown: heads, scripts, styles, templates, and elements that are ``hidden`` or styled
  ``display: none`` (with all inside) or ``visibility: hidden`` (unless made visible again inside);
* blocks start and end a line, paragraphs and headings are set off by an empty line, ``br`` breaks a line;
  white space collapses except in ``pre`` and ``textarea``;
* items begin with ``- `` or their number, indented by depth (up to ``MAX_INDENT``); images show their alternative text;
* the cells of a table are padded to the width of their column, up to ``MAX_PAD``; cells that span columns or
  rows leave the other places empty; a cell's own lines, also those of a table in it, are joined by spaces.

Null and empty pages give the empty text.  Unclosed and stray tags never fail.  Walks have their own stack,
and tables are laid out from the inside out, so depth is not limited; open elements are found by their
names, so time is linear in the page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of HTML by what a renderer does with them
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = set("head script style template title noembed noframes datalist".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption"
             " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup"
             " option p pre search section summary table tbody td textarea tfoot th thead tr ul caption".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: what a head can hold; any other start tag, and text that is not blank, ends it
IN_HEAD = set("title meta link base basefont bgsound style script noscript noframes template".split())
ENDS_P = BLOCKS - set("td th tr tbody thead tfoot caption option optgroup legend body html".split())
#: a start tag closes the open elements named first, up to the nearest of those named second
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
} | {t: ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
TABLE_PARTS = set("table caption thead tbody tfoot tr td th body html".split())
CELL_EDGE = {"td", "th", "caption"}
LISTS = {"ul", "ol", "menu", "dir"}
# The largest spans of a cell in HTML
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
#: a column is padded to this width at most; its longer cells stand out
MAX_PAD = 200
#: items are indented by this depth at most
MAX_INDENT = 40
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "lines")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.attrs, self.children = tag, dict(attrs), []
        self.lines: list[str] = []  # of a table, once it is laid out


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        # places of the open elements of each name, the innermost last
        self.at: dict[str, list[int]] = defaultdict(list)

    def _push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def _cut(self, place: int) -> None:
        """End the open element at a place and all inside it."""
        for node in reversed(self.open[place:]):
            self.at[node.tag].pop()
        del self.open[place:]

    def _innermost(self, names: set[str]) -> int:
        place, at = 0, self.at
        for tag in names:
            if tag in at and at[tag] and at[tag][-1] > place:
                place = at[tag][-1]
        return place

    def _close(self, names: set[str], stop: set[str]) -> None:
        """End the outermost open element of ``names`` inside the nearest of ``stop``."""
        if not any(self.at.get(t) for t in names):
            return
        edge = self._innermost(stop)
        found = [places[bisect_right(places, edge)] for t in names if (places := self.at.get(t)) and places[-1] > edge]
        if found:
            self._cut(min(found))

    def _end_head(self) -> None:
        while self.open[-1].tag == "head":
            self._cut(len(self.open) - 1)

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in IN_HEAD:
            self._end_head()
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object", "caption"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        place = self._innermost({tag})
        # a stray end tag in a cell ends nothing outside it
        if place and (tag in TABLE_PARTS or self._innermost(CELL_EDGE) <= place):
            self._cut(place)

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            self._end_head()
        if data:
            self.open[-1].children.append(data)


class _Lines:
    """Text under way: finished lines, the current one, and how many empty lines are due."""

    def __init__(self):
        self.done: list[str] = []
        self.now = ""
        self.gap = 0
        self.indent = ""

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.now += first
            for line in rest:
                self.end(keep=True)
                self.now = line
            return
        data = _SPACE.sub(" ", data)
        if not self.now or self.now.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self.now += data

    def end(self, keep: bool = False) -> None:
        line = self.now if keep else self.now.rstrip(" ")
        if line or keep:
            if self.gap and self.done:
                self.done.append("")
            self.gap = 0
            self.done.append(self.indent + line if line else "")
        self.now = ""

    def all(self) -> list[str]:
        self.end()
        while self.done and not self.done[-1].strip():
            self.done.pop()
        return self.done


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(is laid out at all, its text is visible)"""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER_SHOWN or tag == "input" or (tag == "dialog" and "open" not in attrs) or "hidden" in attrs:
        return False, False
    if not attrs.get("style"):
        return True, visible
    style = re.sub(r"\s+", "", attrs["style"].lower())
    if "display:none" in style:
        return False, False
    found = re.search(r"visibility:(\w+)", style)
    return True, found[1] == "visible" if found else visible


def _span(cell: Node, name: str, most: int) -> int:
    """The number of places a cell takes; 0 rows mean all that follow."""
    text = (cell.attrs.get(name) or "1").strip()
    if not re.fullmatch(r"\d+", text, re.ASCII):
        return 1
    n = int(text) if len(text) < 6 else most
    return most if n == 0 and name == "rowspan" else max(1, min(n, most))


def _row_cells(row: Node, visible: bool, taken: dict[int, int]) -> list[str]:
    """Texts of a row's cells by column.  ``taken`` has the rows for which cells above still hold a column, and
    is carried on to the next row."""
    out: list[str] = []
    below: dict[int, int] = {}

    def put(text: str, columns: int, rows: int) -> None:
        while taken.get(len(out)):
            out.append("")
        for i in range(columns):
            if rows > 1:
                below[len(out)] = rows - 1
            out.append("" if i else text)

    for child in row.children:
        if isinstance(child, str):
            if child.strip() and visible:
                put(_SPACE.sub(" ", child).strip(), 1, 1)
            continue
        laid, own = _shown(child, visible)
        if laid:
            put(" ".join(x.strip() for x in render(child, own) if x.strip()), _span(child, "colspan", MAX_COLSPAN),
                _span(child, "rowspan", MAX_ROWSPAN))
    for column, rows in list(taken.items()):
        if rows > 1:
            below.setdefault(column, rows - 1)
    taken.clear()
    taken.update(below)
    return out


def _rows(table: Node, visible: bool) -> tuple[list[str], list[list[str]]]:
    """Lines before the table (its caption, and text outside cells), and its rows."""
    before, rows, loose, taken = [], [], Node("tr"), {}
    work = [(child, visible) for child in reversed(table.children)]
    while work:
        child, seen = work.pop()
        if child is None:  # row spans end with their part of the table
            taken.clear()
            continue
        if isinstance(child, str):
            if child.strip() and seen:
                before.append(_SPACE.sub(" ", child).strip())
            continue
        laid, own = _shown(child, seen)
        if not laid:
            continue
        if child.tag in ("tbody", "thead", "tfoot"):
            taken.clear()
            work += [(None, own), *((c, own) for c in reversed(child.children))]
        elif child.tag == "tr":
            rows.append(_row_cells(child, own, taken))
        elif child.tag in ("td", "th"):  # cells without a row make one together
            loose.children.append(child)
        else:
            before += render(child, own)
    return before, rows + ([_row_cells(loose, visible, {})] if loose.children else [])


def _table_lines(table: Node, visible: bool) -> list[str]:
    before, rows = _rows(table, visible)
    width = [0] * max(map(len, rows), default=0)
    for row in rows:
        for i, cell in enumerate(row):
            width[i] = max(width[i], min(len(cell), MAX_PAD))
    return before + ["  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows]


def _lay_out_tables(top: Node) -> None:
    """Lines of every table that is laid out, inner tables first."""
    found, work = [], [(c, True) for c in reversed(top.children)]
    while work:
        node, seen = work.pop()
        if isinstance(node, str):
            continue
        laid, own = _shown(node, seen)
        if laid:
            if node.tag == "table":
                found.append((node, own))
            work += [(c, own) for c in reversed(node.children)]
    for table, own in reversed(found):
        table.lines = _table_lines(table, own)


def _indent(lists: list) -> str:
    return "  " * min(max(0, len(lists) - 1), MAX_INDENT)


def render(top: Node, visible: bool = True) -> list[str]:
    """Lines of everything visible inside ``top``, whose tables are laid out already."""
    lines = _Lines()
    work = [("in", c, visible, False) for c in reversed(top.children)]
    counters: list[list] = []
    while work:
        what, node, seen, keep = work.pop()
        if what == "out":
            lines.end(keep and bool(lines.now))
            if node.tag in LISTS:
                counters.pop()
            lines.gap = lines.gap or (node.tag in SPACED and not (node.tag in LISTS and counters))
            lines.indent = _indent(counters)
            continue
        if isinstance(node, str):
            if seen:
                lines.text(node, keep)
            continue
        laid, own = _shown(node, seen)
        if not laid:
            continue
        if node.tag == "br":
            lines.end(keep=not lines.now and bool(lines.done))
        elif node.tag == "img" and own and node.attrs.get("alt"):
            lines.text(node.attrs["alt"], False)
        if node.tag not in BLOCKS:
            work += [("in", c, own, keep) for c in reversed(node.children)]
            continue
        lines.end()
        lines.gap = lines.gap or node.tag in SPACED
        if node.tag == "table":
            for line in node.lines:
                lines.now = line
                lines.end()
            lines.gap = 1
            continue
        if node.tag in LISTS:
            start = node.attrs.get("start") or "1"
            counters.append([node.tag == "ol", int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0])
            lines.gap = 0 if len(counters) > 1 else lines.gap
        lines.indent = _indent(counters)
        if node.tag == "li" and own:
            if counters and counters[-1][0]:
                counters[-1][1] += 1
                lines.now = f"{counters[-1][1]}. "
            else:
                lines.now = "- "
        work.append(("out", node, own, keep))
        inside = keep or node.tag in ("pre", "textarea")
        work += [("in", c, own, inside) for c in reversed(node.children)]
    return lines.all()


def page_text(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    _lay_out_tables(builder.root)
    return "\n".join(render(builder.root))


def visible_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def shown(pages: pa.Array) -> pa.Array:
        return pa.array([page_text(p) for p in pages.to_pylist()], pa.string())

    return shown(html)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``visible_text``, ``n_chars`` and ``n_lines``; columns of these names are replaced.
    Repeated pages each get their row."""
    return (pages.withColumn("visible_text", visible_text(F.col(html)))
            .withColumn("n_chars", F.length("visible_text").cast("long"))
            .withColumn("n_lines", F.when(F.col("visible_text") == "", 0)
                        .otherwise(F.size(F.split("visible_text", "\n"))).cast("long")))
