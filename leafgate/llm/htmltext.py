"""Visible text of HTML pages, laid out.

A page becomes a tree: end tags that HTML lets authors omit are implied (a paragraph ends where a
block begins, a list item, table cell, row or option where the next one does), stray end tags are
ignored; what lies in elements deeper than `DEEPEST` hangs on that level, in its order, and their hiding and end tags hold. Tags are read
as HTML says: a quote opens a value only after an equals sign. Then the tree is rendered. Everything a browser would
show is kept, navigation, footers, formulas and the labels of drawings too; what it would not show is left out: head, scripts, styles, templates,
`hidden`, `display:none`, passwords, closed details and dialogs, and fallback content. `visibility` is inherited: what it hides is left out, but for
descendants that are set visible again.
Runs of white space become one space. Blocks begin on a new line, paragraphs, headings, lists and tables
stand between blank lines; items carry a bullet or number and are indented by level; preformatted text
stays as it is; the cells of a table's columns are aligned (up to `WIDEST` characters, so a long cell widens nothing but itself),
row and column spans included, up to `MOST_ROWS` and `MOST_SPAN` as HTML has it, and no row span beyond its group of rows. A cell outside a row implies one; what else stands between
the cells comes before the table, and a form that begins there holds nothing. Ordered lists count as they say (start, value, reversed, type).

Defined results: a null or empty page gives an empty text and zero counts; text without tags is itself; an unclosed
comment or script reaches to the end of the page, and so does a tag after which no > follows; a tag whose quote never closes ends at its first >; however long
and deep a page is, it is read whole; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

DEEPEST, WIDEST, MOST_SPAN, MOST_ROWS = 512, 60, 1000, 65534
#: Frames of the interpreter that rendering a page of that depth needs, and more.
FRAMES = 10_000
RESULT = "page_id long, title string, text string, n_lines long, n_items long, n_tables long"

_words = lambda s: frozenset(s.split())
# HTML's own sets of elements. Fixed values.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style xmp iframe noembed noframes noscript")
RCDATA = _words("title textarea")
UNSEEN = _words("head title script style template noscript iframe noembed noframes object audio video canvas datalist meta link base desc metadata defs symbol annotation annotation-xml")
PARAGRAPH_ENDERS = _words("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd")
BLOCK = PARAGRAPH_ENDERS | _words("html body caption tr td th thead tbody tfoot option optgroup legend")
SPACED = _words("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure menu dir")
TABLE_PARTS = _words("table thead tbody tfoot tr")
TYPED = _words("text search email number url tel date datetime-local month week time submit button reset")
FORMATTING = _words("a b big code em font i nobr s small strike strong tt u")
# Start tag: open elements that it ends, and those beyond which it does not look.
IMPLIED = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "td": (_words("td th caption colgroup"), _words("tr table")),
    "th": (_words("td th caption colgroup"), _words("tr table")),
    "tr": (_words("tr td th caption colgroup"), _words("table")),
    "thead": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "tbody": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "tfoot": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "option": (_words("option"), _words("select optgroup datalist")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "body": (_words("head"), _words("html")),
}
_SCOPE = _words("table td th caption button object template html")
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
    r"(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^ \t\n\r\f>]*+))?+)*+)>"
)
_ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^ \t\n\r\f>]*+)))?+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BREAK = "\x00"


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def hidden(self) -> bool:
        a = self.attributes
        return (
            self.tag in UNSEEN
            or "hidden" in a
            or ("style" in a and bool(_NOT_SHOWN.search(a["style"])))
            or (self.tag == "dialog" and "open" not in a)
        )


def _visible(node: Node, shown: bool) -> bool:
    """Takes out what `visibility` hides; whether anything is left. shown: what the node inherits."""
    if m := [*_VISIBILITY.finditer(node.attributes.get("style", ""))]:
        shown = m[-1][1].lower() in ("visible", "initial")
    node.children = [c for c in node.children if (shown if isinstance(c, str) else _visible(c, shown))]
    return shown or bool(node.children)


class Deep:
    """Open elements beyond the deepest level, of which only tags and hiding are kept."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []
        self.count: Counter[str] = Counter()

    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def push(self, node: Node) -> None:
        self.open.append((node.tag, self.hidden() or node.hidden() or any(m[1].lower() in ("hidden", "collapse") for m in _VISIBILITY.finditer(node.attributes.get("style", "")))))
        self.count[node.tag] += 1

    def close(self, tag: str) -> bool:
        """Whether an element of that tag was open here; it and what it holds is closed."""
        if not self.count[tag]:
            return False
        while self.open:
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last == tag:
                break
        return True

    def start(self, tag: str) -> None:
        """What a start tag ends by implication."""
        if self.open and (self.open[-1][0] == "p" and tag in PARAGRAPH_ENDERS or tag in IMPLIED and self.open[-1][0] in IMPLIED[tag][0]):
            self.close(self.open[-1][0])

    def clear(self) -> None:
        self.open.clear()
        self.count.clear()


def _attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(said):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def parse(page: str) -> Node:
    page = page.replace(_BREAK, "")
    root = Node("html")
    stack = [root]
    deep = Deep()
    at, n = 0, len(page)

    def text(said: str) -> None:
        if said and not deep.hidden():
            stack[-1].children.append(unescape(said) if "&" in said else said)

    def close(tags: frozenset[str], stop: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return close(tags, stop)
            if stack[i].tag in stop:
                return None

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif not (after.isalpha() and after.isascii()) and not re.match(r"/[a-zA-Z]", page[lt + 1 : lt + 3]):
            text("<")
            at = lt + 1
        elif not (m := _TAG.match(page, lt)):
            break
        else:
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                if deep.open and (deep.close(tag) or tag in FORMATTING):
                    if tag in BLOCK and not deep.hidden():
                        stack[-1].children.append(Node(tag))  # nothing but a line's end
                    continue
                open_now = len(stack)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if tag in FORMATTING and stack[i].tag in BLOCK:
                        break  # it ends no block that began inside
                    if stack[i].tag in _SCOPE and tag not in IMPLIED and tag != "table":
                        break
                if len(stack) < open_now:
                    deep.clear()
                continue
            if deep.open:
                deep.start(tag)
            elif tag in PARAGRAPH_ENDERS:
                close(frozenset(["p"]), _SCOPE)
            if tag in IMPLIED and not deep.open:
                close(*IMPLIED[tag])
            if tag in ("html", "body") and (tag == "html" or any(x.tag == "body" for x in stack)):
                continue
            if tag == "form" and not deep.open and stack[-1].tag in TABLE_PARTS:
                continue  # one that begins between the cells of a table holds nothing
            if tag in ("td", "th") and not deep.open and stack[-1].tag in TABLE_PARTS and stack[-1].tag != "tr" and len(stack) < DEEPEST:
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(tag, _attributes(m[3]) if m[3] else None)
            if not deep.hidden():
                stack[-1].children.append(node)
            if tag in VOID:
                continue
            if tag in RAW or tag in RCDATA:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                inner = page[at : end.start() if end else n]
                node.children.append(unescape(inner) if tag in RCDATA else inner)
                gt = page.find(">", end.end()) if end else -1
                at = n if gt < 0 else gt + 1
            elif len(stack) < DEEPEST:
                stack.append(node)
            else:
                deep.push(node)
    _visible(root, True)
    return root


class Flow:
    """Blocks of one container: whether each wants a blank line around it, and its lines."""

    def __init__(self, counts: dict[str, int]):
        self.out: list[tuple[bool, list[str]]] = []
        self.inline: list[str] = []
        self.counts = counts

    def flush(self) -> None:
        said = "".join(self.inline)
        self.inline.clear()
        lines = [_SPACE.sub(" ", x).strip(" ").replace("\xa0", " ") for x in said.split(_BREAK)]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        if lines:
            self.out.append((False, lines))

    def add(self, spaced: bool, lines: list[str]) -> None:
        if lines:
            self.out.append((spaced, lines))

    def lines(self) -> list[str]:
        self.flush()
        done: list[str] = []
        before = False
        for spaced, lines in self.out:
            if done and (spaced or before):
                done.append("")
            done += lines
            before = spaced
        return done

    def walk(self, children: list, level: int = 0) -> Flow:
        for x in children:
            if isinstance(x, str):
                self.inline.append(x)
            elif x.hidden():
                continue
            elif x.tag == "br":
                self.inline.append(_BREAK)
            elif x.tag == "img":
                self.inline.append(x.attributes.get("alt", ""))
            elif x.tag == "input":
                self.inline.append(_typed(x))
            elif x.tag not in BLOCK:
                self.walk(x.children, level)
            else:
                self.flush()
                self.block(x, level)
        return self

    def inner(self, children: list, level: int) -> list[str]:
        return Flow(self.counts).walk(children, level).lines()

    def block(self, x: Node, level: int) -> None:
        if x.tag in ("ul", "ol", "menu", "dir"):
            self.list(x, level)
        elif x.tag == "li":
            self.add(False, self.item(x, "- ", level))
        elif x.tag == "table":
            self.counts["n_tables"] += 1
            self.add(True, table_lines(x, self.counts, level))
        elif x.tag == "pre":
            said = re.sub(r"^\r?\n", "", _raw(x)).replace("\xa0", " ").replace("\r\n", "\n")
            self.add(True, said.rstrip("\n").split("\n") if said.strip() else [])
        elif x.tag == "details" and "open" not in x.attributes:
            self.add(False, self.inner([c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1], level))
        elif x.tag in ("blockquote", "dd"):
            self.add(x.tag in SPACED, ["    " + s if s else s for s in self.inner(x.children, level)])
        else:
            self.add(x.tag in SPACED, self.inner(x.children, level))

    def item(self, x: Node, mark: str, level: int) -> list[str]:
        self.counts["n_items"] += 1
        lines = self.inner(x.children, level + 1) or [""]
        return [(mark + lines[0]).rstrip(" ")] + [" " * len(mark) + s if s else s for s in lines[1:]]

    def list(self, x: Node, level: int) -> None:
        items = [c for c in x.children if isinstance(c, Node) and c.tag == "li" and not c.hidden()]
        step = -1 if "reversed" in x.attributes else 1
        n = _whole(x.attributes.get("start"), len(items) if step < 0 else 1)
        kind = x.attributes.get("type", "1")
        lines: list[str] = []
        for c in x.children:
            if isinstance(c, Node) and c.tag == "li" and not c.hidden():
                n = _whole(c.attributes.get("value"), n)
                lines += self.item(c, f"{_numeral(n, c.attributes.get('type', kind))}. " if x.tag == "ol" else "- ", level)
                n += step
            else:
                lines += self.inner([c], level + 1)
        self.add(level == 0, lines)


def _typed(x: Node) -> str:
    """What an input shows."""
    kind = x.attributes.get("type", "text").lower()
    return x.attributes.get("alt" if kind == "image" else "value", "") if kind in TYPED or kind == "image" else ""


def _whole(said: str | None, otherwise: int) -> int:
    return int(said) if said and re.fullmatch(r"-?[0-9]{1,9}", said) else otherwise


def _numeral(n: int, kind: str) -> str:
    """The number of an item: in letters or Roman if the list says so and the number has such a form."""
    said = ""
    if kind in ("a", "A") and n > 0:
        while n:
            n, digit = divmod(n - 1, 26)
            said = chr(ord("a") + digit) + said
    elif kind in ("i", "I") and 0 < n < 4000:
        for power, (one, five, ten) in ((1000, "m  "), (100, "cdm"), (10, "xlc"), (1, "ivx")):
            digit = n // power % 10
            said += one + ten if digit == 9 else one + five if digit == 4 else five * (digit > 4) + one * (digit % 5)
    return (said.upper() if kind.isupper() else said) or str(n)


def _raw(x: Node) -> str:
    """Preformatted text; blocks in it are lines of their own."""
    out, todo = [], [*reversed(x.children)]
    while todo:
        c = todo.pop()
        if c is None:
            if out and not out[-1].endswith("\n"):
                out.append("\n")
        elif isinstance(c, str):
            if c:
                out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in ("img", "input") and not c.hidden():
            if said := c.attributes.get("alt", "") if c.tag == "img" else _typed(c):
                out.append(said)
        elif not c.hidden():
            todo += [None, *reversed(c.children), None] if c.tag in BLOCK else reversed(c.children)
    return "".join(out)


def _rows(x: Node) -> tuple[list[list[list[Node]]], list[Node], list]:
    """Groups of rows of cells in the order of display, captions, and what stands between cells: a browser shows that before the table."""
    groups: dict[str, list[list[list[Node]]]] = {"thead": [], "tbody": [], "tfoot": []}
    captions: list[Node] = []
    before: list = []
    open_group: list[list[Node]] | None = None  # of rows that are in no group

    def shown(c) -> bool:
        return bool(c.strip()) if isinstance(c, str) else not c.hidden() and c.tag not in ("colgroup", "col")

    def row(children: list) -> list[Node]:
        kept = [c for c in children if shown(c)]
        cells = [c for c in kept if isinstance(c, Node) and c.tag in ("td", "th")]
        before.extend(c for c in kept if not (isinstance(c, Node) and c.tag in ("td", "th")))
        return cells

    def add(group: list[list[Node]], c) -> None:
        """One child of a group: a row, a cell beyond the deepest row, or something else."""
        if isinstance(c, Node) and c.tag == "tr":
            group.append(row(c.children))
        elif isinstance(c, Node) and c.tag in ("td", "th"):
            group.append([c])
        else:
            before.append(c)

    for c in x.children:
        if not shown(c):
            continue
        if isinstance(c, Node) and c.tag == "caption":
            captions.append(c)
        elif isinstance(c, Node) and c.tag in groups:
            rows: list[list[Node]] = []
            for r in filter(shown, c.children):
                add(rows, r)
            groups[c.tag].append(rows)
            open_group = None
        else:
            if open_group is None:
                open_group = []
                groups["tbody"].append(open_group)
            add(open_group, c)
    return groups["thead"] + groups["tbody"] + groups["tfoot"], captions, before


def _span(x: Node, name: str, most: int) -> int:
    said = x.attributes.get(name, "1")
    return min(most, int(said)) if re.fullmatch(r"[0-9]{1,6}", said) else 1


def table_lines(x: Node, counts: dict[str, int], level: int) -> list[str]:
    groups, captions, before = _rows(x)
    grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, span and lines of its cells
    widths: dict[int, int] = {}
    for rows in groups:
        taken: dict[int, int] = {}  # column: rows that a cell from above still covers; none reaches beyond its group
        for r in rows:
            cells, column = [], 0
            begun: dict[int, int] = {}
            for c in r:
                while taken.get(column, 0):
                    column += 1
                lines = Flow(counts).walk(c.children, level + 1).lines()
                wide, tall = max(1, _span(c, "colspan", MOST_SPAN)), _span(c, "rowspan", MOST_ROWS) or MOST_ROWS  # 0: to the end of the group
                cells.append((column, wide, lines))
                for k in range(column, column + wide):
                    begun[k] = tall
                if wide == 1:
                    widths[column] = min(WIDEST, max([widths.get(column, 0), *map(len, lines)]))
                column += wide
            taken = {k: v - 1 for k, v in {**taken, **begun}.items() if v > 1}
            grid.append(cells)
    starts, at = {}, 0
    for k in range(max([-1, *(c + w - 1 for cells in grid for c, w, _ in cells)]) + 1):
        starts[k] = at
        at += widths[k] + 2 if widths.get(k) else 0
    out = Flow(counts).walk(before, level).lines() + [s for c in captions for s in Flow(counts).walk(c.children, level).lines()]
    for cells in grid:
        for i in range(max([0, *(len(lines) for _, _, lines in cells)])):
            line = ""
            for column, _, lines in cells:
                said = lines[i] if i < len(lines) else ""
                if said:
                    line = line.ljust(starts[column]) + ("  " if line and len(line) >= starts[column] and not line.endswith("  ") else "") + said
            out.append(line.rstrip(" "))
    return out


def render(page: str) -> tuple[str, str, int, int]:
    """Title, visible text, list items and tables."""
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    root = parse(page)
    counts = {"n_items": 0, "n_tables": 0}
    text = "\n".join(Flow(counts).walk(root.children).lines())
    title, todo = "", [root]
    while todo and not title:
        x = todo.pop()
        if x.tag == "title" and x.children:
            title = _SPACE.sub(" ", x.children[0]).strip()
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return title, text, counts["n_items"], counts["n_tables"]


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, title, text, n_lines, n_items, n_tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                title, text, items, tables = zip(*(render(x.as_py() or "") for x in batch.column("html")))
                lines = [t.count("\n") + 1 if t else 0 for t in text]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(title), pa.array(text), pa.array(lines), pa.array(items, pa.int64()), pa.array(tables, pa.int64())], ["page_id", "title", "text", "n_lines", "n_items", "n_tables"])

    return pages.select("page_id", "html").mapInArrow(run, RESULT)
