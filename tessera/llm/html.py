"""Layout-aware text of HTML pages.

Markup is parted into tags and text, built into a tree with implied tags (a paragraph ends
before a block, a row needs a table and a cell a row), and rendered as a page would show
it: hidden elements give nothing, blocks stand apart by blank lines, list items carry their
marks and indents, and the cells of a table's rows line up in columns. All visible text
is kept, and the white space that is added grows with the page only: a column is at most
``WIDEST`` wide (a longer cell pushes on what follows in its row), and nothing is indented
or aligned below ``DEEPEST`` levels of lists, quotes and tables.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, small_batches

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile("[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)

#: Columns are aligned up to this width.
WIDEST = 64
#: Levels of lists, quotes and tables that are indented or aligned; below them items keep their marks and each cell has lines of its own.
DEEPEST = 32

# Fixed values of the HTML standard: element kinds and which open element a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("area base datalist head iframe link meta noembed noframes noscript param rp script source style template title track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption".split()
)
#: Blocks with a blank line around them; the others only stand on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr fieldset menu dir".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html", "dd", "dt", "li", "option", "optgroup", "legend", "caption"}
#: Start tag -> open elements it ends, and the elements beyond which it doesn't look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def shown(self) -> bool:
        if self.tag in HIDDEN or "hidden" in self.attrs:
            return False
        if self.tag == "input" and self.attrs.get("type", "").lower() == "hidden":
            return False
        if self.tag == "dialog" and "open" not in self.attrs:
            return False
        return self.style("display") != "none"

    def style(self, name: str) -> str:
        """The last value that the style attribute gives a property; blank without one."""
        own = self.attrs.get("style")
        return next((m[2].lower() for m in reversed(list(_STYLE.finditer(own))) if m[1].lower() == name), "") if own else ""

    def seen(self, inherited: bool) -> bool:
        """Whether own text is visible; visibility is inherited until an element sets it again."""
        value = self.style("visibility")
        return inherited if value in ("", "inherit", "unset") else value not in ("hidden", "collapse")


def tree(markup: str) -> Node:
    """Build the tree of a page or fragment; any input gives one."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of the open elements of each name but the root

    def put(node: Node) -> None:
        stack[-1].children.append(node)
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def pop() -> None:
        places[stack.pop().tag].pop()

    def last(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these names, 0 without one."""
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    def close(tags: set[str], within: set[str]) -> None:
        beyond, first = last(within), 0
        for x in tags:
            for place in reversed(places.get(x, ())):
                if place <= beyond:
                    break
                first = min(first or place, place)
        while first and len(stack) > first:
            pop()

    at, size = 0, len(markup)
    while at < size:
        begin = markup.find("<", at)
        if begin < 0:
            begin = size
        if begin > at:
            stack[-1].children.append(html.unescape(markup[at:begin]))
            at = begin
            continue
        found = _MARKUP.match(markup, at)
        if not found:  # a lone "<" is text
            stack[-1].children.append("<")
            at += 1
            continue
        at = found.end()
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if found["end"]:
            if tag in ("br", "p") and not places.get(tag):
                stack[-1].children.append(Node(tag))
                continue
            place = last((tag,))
            if place and (tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") or place > last(("td", "th", "table"))):
                while len(stack) > place:
                    pop()
            continue
        attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(found["attrs"])} if found["attrs"].strip(" /\n\t") else {}
        if tag in ("html", "body") and len(stack) > 0:
            if tag == "body":
                close({"head"}, set())
            stack[0].attrs = {**attrs, **stack[0].attrs}
            continue
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            pop()  # the head ends where content begins
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "button", "li", "object"})
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        if tag in ("td", "th") and stack[-1].tag != "tr":
            put(Node("tr"))
        if tag == "tr" and not places.get("table"):
            put(Node("table"))
        node = Node(tag, attrs)
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(markup, at)
            inside = markup[at : end.start()]
            node.children.append(html.unescape(inside) if tag in ("textarea", "title") else inside)
            stack[-1].children.append(node)
            at = end.end()
        else:
            put(node)
    return root


class Page:
    """Lines of rendered text; blank lines are due between blocks and never doubled."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False

    def text(self, text: str, preserve: bool = False) -> None:
        if preserve:
            first, *more = text.split("\n")
            self.line.append(first)
            for x in more:
                self.end(keep=True)
                self.line.append(x)
        else:
            self.line.append(_SPACE.sub(" ", text))

    def end(self, keep: bool = False) -> None:
        line = "".join(self.line)
        self.line = []
        line = line.rstrip() if keep else _SPACE.sub(" ", line).strip(" ")
        if line or keep:
            self.write([line])

    def write(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or spaced


def _finish(render: Generator) -> list[str] | None:
    """What a render step returns. Steps yield the steps they need, which are held on a list: nesting has no depth it can't reach."""
    steps, value = [render], None
    while steps:
        try:
            step = steps[-1].send(value)
        except StopIteration as done:
            steps.pop()
            value = done.value
        else:
            steps.append(step)
            value = None
    return value


def render_into(page: Page, node: Node, seen: bool, depth: int, pre: bool = False) -> Generator:
    for child in node.children:
        if isinstance(child, str):
            if seen:
                page.text(child, pre)
            continue
        tag = child.tag
        if not child.shown():
            continue
        own = child.seen(seen)
        if tag == "br":
            if own:
                page.end(keep=True) if page.line or pre else page.write([""])
        elif tag == "hr":
            page.block(True)
        elif tag == "table" and depth < DEEPEST:
            page.block(True)
            page.write((yield table_lines(child, own, depth + 1)))
            page.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(True)
            if depth < DEEPEST:
                page.write((yield list_lines(child, own, depth + 1)))
            else:
                yield list_into(page, child, own, depth)
            page.block(True)
        elif tag == "img" or tag == "input":
            if own and tag == "input" and child.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url"):
                page.text(child.attrs.get("value", ""))
        elif tag in BLOCK or tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            page.block(tag in SPACED)
            if tag in ("dd", "blockquote") and depth < DEEPEST:
                page.write(["  " + x if x else "" for x in (yield lines_of(child, own, depth + 1))])
            else:
                yield render_into(page, child, own, depth, pre or tag == "pre" or tag == "textarea")
                if tag == "pre":
                    page.end(keep=True) if any(x.strip() for x in page.line) else page.line.clear()
            page.block(tag in SPACED)
        else:
            yield render_into(page, child, own, depth, pre or tag == "textarea")


def lines_of(node: Node, seen: bool = True, depth: int = 0) -> Generator:
    page = Page()
    yield render_into(page, node, seen, depth)
    page.end()
    return page.lines


def _first(node: Node) -> int:
    start = node.attrs.get("start", "1")
    return int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1


def list_lines(node: Node, seen: bool, depth: int) -> Generator:
    """Items with their mark, further lines indented below the text; other content as it comes."""
    out: list[str] = []
    number = _first(node)
    for child in node.children:
        if isinstance(child, str):
            if seen and child.strip():
                out.append(_SPACE.sub(" ", child).strip())
        elif child.shown():
            own = child.seen(seen)
            if child.tag == "li":
                lines = yield lines_of(child, own, depth)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                if own:
                    out += [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines or [""])]
                else:  # a hidden item's mark is hidden, what is visible in it isn't
                    out += lines
            else:
                out += yield lines_of(_wrap(child), seen, depth)
    return [x.rstrip() for x in out]


def list_into(page: Page, node: Node, seen: bool, depth: int) -> Generator:
    """Items of a list that is too deep for indents, with their marks."""
    number = _first(node)
    for child in node.children:
        if isinstance(child, str):
            if seen and child.strip():
                page.text(child)
        elif child.tag == "li" and child.shown():
            page.block(False)
            if own := child.seen(seen):
                page.text(f"{number}. " if node.tag == "ol" else "- ")
            number += 1
            yield render_into(page, child, own, depth)
            page.block(False)
        else:
            yield render_into(page, _wrap(child), seen, depth)


def _wrap(node: Node) -> Node:
    holder = Node("div")
    holder.children.append(node)
    return holder


def _span(cell: Node, name: str, most: int) -> int:
    """A colspan or rowspan, within the bounds that the HTML standard sets."""
    value = cell.attrs.get(name, "1").strip()
    if not re.fullmatch("[0-9]+", value):
        return 1
    value = value.lstrip("0")
    return min(int(value or 0), most) if len(value) < 9 else most


def _rows(node: Node, rows: list[list[tuple[list[str], int, int]]], before: list[str], seen: bool, depth: int) -> Generator:
    """Rows of cells (lines, columns, rows); 0 rows are all that follow."""
    for child in node.children:
        if isinstance(child, str):
            if seen and child.strip():
                before.append(_SPACE.sub(" ", child).strip())
            continue
        if not child.shown():
            continue
        own = child.seen(seen)
        if child.tag == "tr":
            cells: list[tuple[list[str], int, int]] = []
            for cell in child.children:
                if isinstance(cell, str):
                    if own and cell.strip():
                        cells.append(([_SPACE.sub(" ", cell).strip()], 1, 1))
                elif cell.shown():
                    lines = yield lines_of(cell, cell.seen(own), depth) if cell.tag in ("td", "th") else lines_of(_wrap(cell), own, depth)
                    cells.append((lines, max(_span(cell, "colspan", 1000), 1), _span(cell, "rowspan", 65534)))
            rows.append(cells)
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield _rows(child, rows, before, own, depth)
        else:
            before += yield lines_of(_wrap(child), seen, depth)


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[dict[int, list[str]]]:
    """For each row its cells by column; those that reach down from rows above keep their columns free."""
    placed, taken = [], {}  # column -> the row before which it is free again
    for y, cells in enumerate(rows):
        x, own = 0, {}
        for lines, wide, high in cells:
            while taken.get(x, 0) > y:
                x += 1
            own[x] = lines
            if high != 1:
                taken.update(dict.fromkeys(range(x, x + wide), y + high if high else len(rows)))
            x += wide
        placed.append(own)
    return placed


def table_lines(node: Node, seen: bool, depth: int) -> Generator:
    """Rows with their columns aligned, two spaces apart; captions and stray content come first.

    A cell that spans rows stands in the first of them, one that spans columns in the first of them. Cells wider than
    ``WIDEST`` don't widen their column; what follows in their row stands two spaces after them. A line's cells are moved
    by a column's width for each of them and two more at most, whatever the columns are that are spanned before them.
    """
    rows: list[list[tuple[list[str], int, int]]] = []
    out: list[str] = []
    yield _rows(node, rows, out, seen, depth)
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for cells in placed:
        for x, lines in cells.items():
            widths[x] = max(widths.get(x, 0), max((len(line) for line in lines if len(line) <= WIDEST), default=0))
    begin, at = {}, 0
    for x in sorted(widths):  # those in which a cell begins
        begin[x], at = at, at + widths[x] + 2
    for cells in placed:
        lines = [[] for _ in range(max(map(len, cells.values()), default=0))]
        for n, x in enumerate(sorted(cells)):
            for line, text in zip(lines, cells[x], strict=False):
                if text:
                    line.append((n, x, text))
        for line in lines:
            parts, size, room = [], 0, 2 * (WIDEST + 2)
            before = -1
            for n, x, text in line:
                room += (WIDEST + 2) * (n - before)
                gap = min(max(begin[x] - size, 2 if parts else 0), room)
                parts += [" " * gap, text]
                size, room, before = size + gap + len(text), room - gap, n
            out.append("".join(parts).rstrip())
    return out


def text_of(markup: str | None) -> str:
    """The visible text of a page; empty for null."""
    root = tree(markup or "")
    return "\n".join(_finish(lines_of(root, root.seen(True)))).strip("\n") if root.shown() else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars of every page.

    Null and empty pages give an empty text; text without markup is kept, its white space
    folded. Very long pages are rendered whole, one at a time, whatever their depth, with white space
    in proportion to the page. A tag with a quote that is never closed ends at its next ``>`` and is not shown. Repeated rows are rendered alike, and nothing depends on
    an order of rows, so ties don't matter; an empty table gives no rows; extra columns are ignored, whatever they are called.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                found = [text_of(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id bigint, text string, n_chars bigint")
