"""Rendering of HTML pages as plain text with their layout.

A tree builder takes tags, adds the end tags that HTML implies (a new `li` ends the open one, a block
ends an open `p`, ...) and closes what is left open. The renderer walks the tree: invisible
elements go, blocks stand on lines of their own with blank lines around paragraphs, headings, lists
and tables, lists keep bullets or numbers and their nesting, table cells are padded to columns, and `pre`
keeps its white space. All visible text is kept; nothing is judged to be boilerplate. Formulas (MathML) give their
symbols in a row, drawings (SVG) their labels on lines of their own; what `use` repeats is not repeated.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.llm.base import rebatched

BATCH_ROWS = 64
#: Elements nested deeper than this hold nothing; what follows goes to the one around them, as in browsers.
DEEPEST_TREE = 512
#: Lists, tables and quotes nested deeper than this are laid out as plain blocks.
DEEPEST = 40

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template title iframe noembed noframes object audio video canvas datalist area base link meta param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr menu dir listing".split())
#: Drawings and formulas; within them, what holds HTML again, what is not shown, what stands on a line of its own.
FOREIGN = frozenset("svg math".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
NOT_SHOWN = frozenset("defs symbol desc metadata annotation annotation-xml mphantom".split())
OWN_LINE = frozenset("text foreignobject mtr mlabeledtr".split())
#: HTML elements that end a drawing or formula around them.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Marks of the tree builder; no attribute of a page has a blank in its name.
UNSHOWN, ON_LINE = "not shown", "on a line"
BARE_VALUE = re.compile(r"=\s*[^\s\"'=<>`]+\Z")
CDATA = "<![CDATA["
BLOCKS = SPACED | frozenset("html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup li legend main nav optgroup option search section summary tr caption tbody thead tfoot td th".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED_END = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr", "caption", "colgroup"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "thead": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"),
    "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"),
    "tfoot": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"),
}
#: An implied end tag never reaches beyond these.
BARRIERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
TABLE_BARRIER = ("table",)
P_BARRIER = frozenset("table td th caption button object template html foreignobject annotation-xml mtext".split())

TOKEN = re.compile(
    r"<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.IGNORECASE)
SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes = name, attributes
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The tree of a page; unknown end tags are ignored, open elements end with the page."""
    root = Node("html", {})
    open_ = [root]
    at, n = 0, len(page)
    drawn = False  # pages without drawings and formulas need not look for them
    while at < n:
        if drawn and page.startswith(CDATA, at) and _foreign(open_):
            end = page.find("]]>", at)
            open_[-1].children.append(page[at + len(CDATA) : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        found = TOKEN.match(page, at)
        at = found.end()
        if found["text"] is not None:
            open_[-1].children.append(html.unescape(found["text"]))
            continue
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if found["end"]:
            if name == "p" and not _reaches(open_, "p", P_BARRIER):
                open_[-1].children.append(Node("p", {}))
            elif name == "br":
                open_[-1].children.append(Node("br", {}))
            else:
                _close(open_, name)
            continue
        attributes = _attributes(found["attributes"]) if found["attributes"].strip(" /") else {}
        if drawn and name in BREAKOUT:
            while _foreign(open_):
                open_.pop()
        foreign = drawn and _foreign(open_)
        if foreign or name in FOREIGN:
            drawn = True
            if foreign and (name in NOT_SHOWN or attributes.get("display", "").strip() == "none" or attributes.get("visibility", "").strip() in ("hidden", "collapse")):
                attributes[UNSHOWN] = ""
            if foreign and name in OWN_LINE:
                attributes[ON_LINE] = ""
            if _self_closing(found["attributes"]):  # holds nothing; elsewhere the slash means nothing
                continue
        if name in ("html", "body"):  # there is one of each; hidden attributes of a second one do not count
            if name == "body":
                _close(open_, "head")
            if not root.attributes and name == "html":
                root.attributes = attributes
            elif name == "body":
                node = Node("body", attributes)
                open_[-1].children.append(node)
                open_.append(node)
            continue
        if name in ENDS_P and _reaches(open_, "p", P_BARRIER):
            _close(open_, "p")
        if name in IMPLIED_END:
            _imply(open_, IMPLIED_END[name], BARRIERS.get(name, TABLE_BARRIER))
        elif open_[-1].name == "option" and name == "hr":
            open_.pop()
        node = Node(name, attributes)
        open_[-1].children.append(node)
        if name in RAW_TEXT:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if name not in INVISIBLE:
                text = page[at:stop]
                node.children.append(html.unescape(text) if name == "textarea" else text)
            at = end.end() if end else n
        elif name not in VOID and len(open_) < DEEPEST_TREE:
            open_.append(node)
    return root


def _foreign(open_: list[Node]) -> bool:
    """Is the innermost open element part of a drawing or formula, and no place for HTML in it?"""
    for node in reversed(open_):
        if node.name in HTML_INSIDE:
            return False
        if node.name in FOREIGN:
            return True
    return False


def _self_closing(attributes: str) -> bool:
    return attributes.endswith("/") and not BARE_VALUE.search(attributes)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def _reaches(open_: list[Node], name: str, barrier) -> bool:
    for node in reversed(open_):
        if node.name == name:
            return True
        if node.name in barrier:
            return False
    return False


def _close(open_: list[Node], name: str) -> None:
    """End the innermost open `name` with all that is open in it; cells and lists keep stray end tags out."""
    scope = ("table",) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("td", "th", "table") if name not in ("table",) else ()
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].name == name:
            del open_[i:]
            return
        if open_[i].name in scope:
            return


def _imply(open_: list[Node], names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
    """End the outermost of the open elements `names` inside the barrier."""
    cut = None
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].name in barrier:
            break
        if open_[i].name in names:
            cut = i
    if cut is not None:
        del open_[cut:]


def visible(node: Node) -> bool:
    attributes = node.attributes
    if node.name in INVISIBLE or "hidden" in attributes or UNSHOWN in attributes:
        return False
    if node.name == "input" and attributes.get("type", "").lower() == "hidden":
        return False
    if node.name == "dialog" and "open" not in attributes:
        return False
    return not HIDING_STYLE.search(attributes.get("style", ""))


def width(text: str) -> int:
    """Columns on a screen: wide characters count as two, combining marks as none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Collects lines; inline text is joined with white space collapsed, blocks begin and end lines."""

    def __init__(self, depth: int = 0):
        self.depth = depth
        self.lines: list[str] = []
        self.line: list[str] = []

    def text(self, text: str) -> None:
        text = SPACES.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.removeprefix(" ")
        if text:
            self.line.append(text)

    def end_line(self, keep_empty: bool = False) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if text or keep_empty:
            self.lines.append(text)

    def gap(self) -> None:
        """One blank line between what is above and what comes."""
        self.end_line()
        if self.lines and self.lines[-1] != "":
            self.lines.append("")

    def whole(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((i for i, x in enumerate(lines) if x), len(lines))
        return lines[start:]


def render(page: str | None) -> str:
    """Visible text of a page; empty for null, empty or wholly invisible pages."""
    if not page:
        return ""
    root = parse(page)
    layout = Layout()
    _walk(root, layout)
    return "\n".join(layout.whole())


def _walk(top: Node, layout: Layout) -> None:
    """Depth first with an explicit stack: pages may nest deeper than Python recurses."""
    stack: list[tuple[str, Node | str]] = [("open", top)]
    while stack:
        step, node = stack.pop()
        if isinstance(node, str):
            layout.text(node)
            continue
        name = node.name
        if step == "close":
            _gap_or_line(layout, name)
            continue
        if not visible(node):
            continue
        if name == "br":
            layout.end_line(keep_empty=True)
        elif name == "hr":
            layout.gap()
            layout.text("---")
            layout.gap()
        elif name == "img":
            if node.attributes.get("alt"):
                layout.text(node.attributes["alt"])
        elif name == "input":
            if node.attributes.get("value"):
                layout.text(node.attributes["value"])
        elif name in ("pre", "textarea", "listing", "xmp"):
            layout.gap()
            _put(layout, _preformatted(node).removeprefix("\n").split("\n"), "", "")
            layout.gap()
        elif name in ("ul", "ol", "menu", "dir") and layout.depth < DEEPEST:
            _list(node, layout)
        elif name == "table" and layout.depth < DEEPEST:
            _table(node, layout)
        elif name in ("td", "th", "mtd"):  # outside of a table
            layout.text(" ")
            stack.extend(("open", c) for c in reversed(node.children))
        else:
            if name in ("blockquote", "dd") and layout.depth < DEEPEST:
                indent = "> " if name == "blockquote" else "    "
                _gap_or_line(layout, name)
                _put(layout, _inner(node, layout), indent, indent)
                _gap_or_line(layout, name)
                continue
            if name in BLOCKS or ON_LINE in node.attributes:
                _gap_or_line(layout, name)
                stack.append(("close", node))
            stack.extend(("open", c) for c in reversed(node.children))


def _gap_or_line(layout: Layout, name: str) -> None:
    if name in SPACED:
        layout.gap()
    else:
        layout.end_line()


def _inner(node: Node, outer: Layout) -> list[str]:
    """Lines of a node's children, laid out on their own."""
    layout = Layout(outer.depth + 1)
    inside = Node("#inside", {})
    inside.children = node.children
    _walk(inside, layout)
    return layout.whole()


def _put(layout: Layout, lines: list[str], first: str, rest: str) -> None:
    layout.end_line()
    for i, line in enumerate(lines):
        layout.lines.append(((first if i == 0 else rest) + line).rstrip(" "))


def _list(node: Node, layout: Layout) -> None:
    layout.gap()
    start = node.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str) or child.name != "li":
            _walk_loose(child, layout)
            continue
        if not visible(child):
            continue
        value = child.attributes.get("value", "")
        if node.name == "ol" and re.fullmatch(r"-?[0-9]{1,9}", value):
            number = int(value)
        mark = f"{number}. " if node.name == "ol" else "- "
        number += 1
        lines = [x for x in _inner(child, layout) if x] or [""]
        _put(layout, lines, mark, " " * len(mark))
    layout.gap()


def _walk_loose(child: Node | str, layout: Layout) -> None:
    if isinstance(child, str):
        layout.text(child)
    else:
        _walk(child, layout)


def _preformatted(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item.replace("\r\n", "\n").replace("\r", "\n"))
        elif item.name == "br":
            out.append("\n")
        elif visible(item):
            stack.extend(reversed(item.children))
    return "".join(out)


def _table(node: Node, layout: Layout) -> None:
    layout.gap()
    rows: list[list[list[str]]] = []
    _rows(node, rows, layout)
    columns = max(map(len, rows), default=0)
    widths = [max((width(line) for row in rows if c < len(row) for line in row[c]), default=0) for c in range(columns)]
    for row in rows:
        for k in range(max([1, *map(len, row)])):
            cells = [(cell[k] if k < len(cell) else "") for cell in row]
            line = "  ".join(x + " " * (widths[c] - width(x)) for c, x in enumerate(cells)).rstrip(" ")
            if line:
                layout.lines.append(line)
    layout.gap()


def _rows(node: Node, rows: list, layout: Layout) -> None:
    """Cells of each visible row; captions and text that stands outside of cells go above the table."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip(" \t\n\f\r"):
                _put(layout, [SPACES.sub(" ", child).strip(" ")], "", "")
        elif not visible(child):
            continue
        elif child.name in ("tbody", "thead", "tfoot"):
            _rows(child, rows, layout)
        elif child.name == "tr":
            row: list[list[str]] = []
            for cell in child.children:
                if isinstance(cell, Node) and cell.name in ("td", "th"):
                    if visible(cell):
                        row.append(_inner(cell, layout))
                        span = cell.attributes.get("colspan", "")
                        row.extend([] for _ in range(min(int(span), 1000) - 1 if re.fullmatch(r"[0-9]{1,4}", span) else 0))
                else:
                    _loose(cell, layout)
            rows.append(row)
        else:
            _loose(child, layout)


def _loose(child: Node | str, layout: Layout) -> None:
    inside = Node("#inside", {})
    inside.children = [child]
    _put(layout, _inner(inside, layout), "", "")


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """All columns of `pages` and `text`, the rendered visible text of the whole page.

    Null and empty pages give an empty text; rows that repeat are rendered each. A column already named like
    `text` is replaced. No shuffle.
    """
    carried = pages.select(F.struct(*[pages[c] for c in pages.columns if c != text]).alias("row"), pages[source].alias("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, BATCH_ROWS):
            out = pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["row", "value"])

    row_type = carried.schema["row"].dataType.simpleString()
    return carried.mapInArrow(run, f"row {row_type}, value string").select("row.*", F.col("value").alias(text))
