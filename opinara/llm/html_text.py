"""HTML extraction by layout: a tree with implied tags, visibility rules, and a text rendering.

The tree builder follows the usual forgiving rules: start tags that end an open paragraph, list item,
table part, option or heading; rows implied by cells; a head that ends at the first body element; end tags
that close whatever is open inside their element, and are ignored where none is open in scope.

Not visible are the head, scripts, styles, templates, comments, elements with the ``hidden`` attribute,
and those whose style sets ``display: none`` or ``visibility: hidden``.

Everything else is rendered: white space collapses outside ``pre``; blocks start on a line of their own,
paragraphs, headings, lists and tables with a blank line around them; list items carry a bullet or their
number and indent with their depth, up to DEEPEST; a table's cells are padded to the width of their column (cells longer
than WIDEST stand out of it, so padding stays in proportion to the cells).

Null and empty pages give null and empty texts. Pages are rendered row by row, so repeated rows give equal
texts. There is no bound on depth or length: neither building nor rendering recurses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST = 60
#: Columns of indentation at most; what is nested deeper stays there, so output is in proportion to the page.
DEEPEST = 160

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas svg".split())
_HEAD = frozenset("title meta link script style base noscript template head html".split())
_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset menu".split())
_BLOCK = _MARGIN | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option section summary tr thead tbody tfoot".split()
)
_ENDS_P = _BLOCK - frozenset("body html tr thead tbody tfoot caption option optgroup legend".split())
#: For a start tag, the open elements it ends, and where the search for them stops.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption"), ("table",)),
    "th": (("td", "th", "caption"), ("table",)),
    "tr": (("td", "th", "tr", "caption"), ("table",)),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), ("table",)),
}
_FENCES = frozenset(("td", "th", "table", "caption", "template"))
_TABLE_PARTS = frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption", "body", "html"))
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
_LOOSE_TAG = re.compile(r"<([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOLD = re.compile(r"hidden|style|colspan|start|value", re.I)
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    if not _TOLD.search(source):
        return {}
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(source)}


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def pop(self) -> None:
        self.count[self.open.pop().tag] -= 1

    def close(self, tags, stops, through: bool = True) -> bool:
        """End the outermost open element of ``tags`` inside the nearest of ``stops``, with all that is in it."""
        if not any(self.count[t] > 0 for t in tags):
            return False
        at = None
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in stops:
                break
            if tag in tags:
                at = k
                if not through:
                    break
        if at is None:
            return False
        while len(self.open) > at:
            self.pop()
        return True

    def start(self, tag: str, source: str) -> None:
        if self.count["head"] and tag not in _HEAD:
            self.close(("head",), ())
        if tag in _ENDS:
            self.close(*_ENDS[tag])
        if tag in _ENDS_P:
            self.close(("p",), _FENCES | {"button"}, through=False)
        if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self.pop()
        if tag in ("td", "th") and self.count["table"] and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", "")
        node = Node(tag, _attributes(source))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif not self.close((tag,), () if tag in _TABLE_PARTS else _FENCES - {tag}, through=False) and tag == "p":
            self.start("p", "")
            self.pop()

    def text(self, data: str) -> None:
        if self.count["head"] and self.open[-1].tag == "head" and not data.isspace():
            self.close(("head",), ())
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    """The tree of a page."""
    builder, at, size = _Builder(), 0, len(html)
    tagless = html.rfind(">")  # no tag can end after it
    while at < size:
        low = html.find("<", at)
        if low < 0 or low > tagless:
            comment = html.find("<!--", at)
            builder.text(unescape(html[at : comment if comment >= 0 else size]))
            break
        found = _TAG.match(html, low) or _LOOSE_TAG.match(html, low)
        if not found:
            builder.text(unescape(html[at : low + 1]))
            at = low + 1
            continue
        if low > at:
            builder.text(unescape(html[at:low]))
        at = found.end()
        if found.re is _LOOSE_TAG:
            closed, opened, source = None, found[1], found[2]
        else:
            closed, opened, source = found[1], found[2], found[3]
        if closed:
            builder.end(closed.lower())
        elif opened:
            tag = opened.lower()
            builder.start(tag, source)
            if tag in _RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                end = stop.start() if stop else size
                data = html[at:end]
                builder.text(unescape(data) if tag in ("textarea", "title") else data)
                at = end
    return builder.root


class _Canvas:
    """Lines of text, the last of them open."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.margin = 0
        self.indent = [0]
        self.marker: tuple[int, str] | None = None

    def text(self, data: str) -> None:
        words = _SPACES.sub(" ", data)
        if words[:1] == " ":
            self.space = bool(self.parts)
            words = words[1:]
        if not words:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words[:-1] if self.space else words)

    def raw(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").split("\n")
        if first:
            self.parts.append(first)
        for line in rest:
            self.line(True)
            if line:
                self.parts.append(line)

    def line(self, always: bool = False) -> None:
        """End the open line; an empty one counts only if ``always``."""
        if self.parts or always:
            if self.margin and self.lines:
                self.lines.extend([""] * self.margin)
            depth, bullet = (self.indent[-1], "") if self.marker is None else self.marker
            self.lines.append((" " * min(depth, DEEPEST) + bullet + "".join(self.parts)).rstrip())
            self.parts, self.marker, self.margin = [], None, 0
        self.space = False

    def block(self, margin: int) -> None:
        self.line()
        self.margin = max(self.margin, margin)

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    widths: list[int] = []
    for row in rows:
        k = 0
        for lines, span in row:
            if span == 1:
                widths += [0] * (k + 1 - len(widths))
                widths[k] = max([widths[k], *(n for n in map(len, lines) if n <= WIDEST)])
            k += span
    out = []
    for row in rows:
        for nth in range(max((len(lines) for lines, _ in row), default=0)):
            cells, k = [], 0
            for lines, span in row:
                width = sum(widths[k : k + span]) + 2 * (len(widths[k : k + span]) - 1)
                cells.append((lines[nth] if nth < len(lines) else "").ljust(max(width, 0)))
                k += span
            out.append("  ".join(cells).rstrip())
    return out


def _number(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else other


def render(root: Node) -> str:
    """The visible text of a tree."""
    canvas = [_Canvas()]
    tables: list[list[list[tuple[list[str], int]]]] = []
    lists: list[int | None] = []
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        now = canvas[-1]
        if isinstance(node, str):
            now.raw(node) if pre else now.text(node)
            continue
        tag = node.tag
        cell = tag in ("td", "th") and bool(tables)
        if not leaving:
            told = node.attributes
            if tag in _UNSEEN or told and ("hidden" in told or _INVISIBLE.search(told.get("style", ""))):
                continue
            if tag == "br":
                now.line(True)
                continue
            if cell:
                if not tables[-1]:
                    tables[-1].append([])
                canvas.append(_Canvas())
                lists.append(None)
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in _BLOCK:
                now.block(1 if tag in _MARGIN and not (tag in ("ul", "ol", "menu") and lists) else 0)
            if tag == "table":
                tables.append([])
            elif tag in ("ul", "menu"):
                lists.append(None)
            elif tag == "ol":
                lists.append(_number(told.get("start"), 1))
            elif tag == "li":
                number = lists[-1] if lists else None
                if number is not None:
                    number = _number(told.get("value"), number)
                    lists[-1] = number + 1
                bullet = "* " if number is None else f"{number}. "
                now.marker = now.indent[-1], bullet
                now.indent.append(now.indent[-1] + len(bullet))
            elif tag in ("dd", "blockquote"):
                now.indent.append(now.indent[-1] + 4)
            elif tag == "pre":
                pre += 1
            todo.append((node, True))
            todo.extend((child, False) for child in reversed(node.children))
            continue
        if cell:
            lists.pop()
            span = min(max(_number(node.attributes.get("colspan"), 1), 1), 1000)
            tables[-1][-1].append((canvas.pop().done(), span))
            continue
        if tag == "table":
            now.block(0)
            for line in _table_lines(tables.pop()):
                now.parts.append(line)
                now.line(True)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "pre":
            pre -= 1
        if tag in _BLOCK and not (tag == "tr" and tables):
            now.block(1 if tag in _MARGIN and not (tag in ("ul", "ol", "menu") and lists) else 0)
        if tag in ("li", "dd", "blockquote"):
            now.indent.pop()
            now.marker = None
    return "\n".join(canvas[0].done()).strip("\n")


def to_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Per row: key, ``text``, and its ``n_chars`` and ``n_lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_text(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    kind = dict(df.dtypes)[key]
    found = df.select(F.col(key).alias("page_id"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kind}, text string")
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
