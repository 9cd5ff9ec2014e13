"""Layout-aware text of HTML pages.

A tree builder with implied tags (a block closes an open paragraph, an item the
item before it, a row or cell the one before it, and so on) makes a tree; a
renderer walks it and writes all text that a reader would see. Blocks stand on
lines of their own, paragraph-like ones with an empty line around them, list
items get a bullet or number and are indented by depth, preformatted text keeps
its spaces, and tables have their cells padded to common column widths.

Not visible: head, script, style, template, noscript, dialog that isn't open,
details bodies that aren't open, titles, descriptions and definitions of SVG,
annotations of MathML, fallbacks of audio, video, canvas and frames, anything
with the ``hidden`` attribute or ``display:none``, and text under
``visibility:hidden`` unless a descendant turns it on again. No text that is
visible is dropped, navigation, SVG texts and fallbacks of objects included.

Edge cases: null and empty pages give an empty text; unclosed tags end with the
page, stray end tags are ignored, an unclosed comment or tag swallows the rest as
browsers do; depth is unbounded. A cell is one line, so a table inside a cell
gives its words in order, at whatever depth, and only the outermost table is
aligned. Repeated rows give repeated results, empty tables an empty result,
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

#: Levels of indent that are written; deeper text stands at this depth.
INDENTS = 24
#: Fixed element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist audio video canvas desc defs metadata symbol annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option summary tbody td tfoot th thead tr".split())
#: Tag -> tags that it closes when it opens, and the ancestors that stop the search.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["table", "tr"])),
    **{t: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}
BARRIERS = frozenset("table td th caption html".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
COLLAPSE = re.compile(r"[ \t\n\r\f]+")
INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]+)")
#: Inputs that show their value, and those that show a placeholder without one.
VALUE_SHOWN = frozenset("text search tel url email number date month week time datetime-local submit reset button".split())
PLACEHOLDER_SHOWN = frozenset("text search tel url email number password".split())
HIDING_INPUTS = frozenset("hidden checkbox radio file image color range".split())
STYLE_NONE = re.compile(r"display\s*:\s*none", re.I)
STYLE_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "children", "attributes")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.children, self.attributes = tag, [], attributes or {}


def parse(html: str) -> Node:
    """The element tree; text is held as strings among the children."""
    root = Node("#root")
    stack = [root]
    is_open: dict[str, int] = {}  # how many of each tag stand open, so that deep pages aren't searched in vain
    pos, n = 0, len(html)

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    def cut(i: int) -> None:
        for x in stack[i:]:
            is_open[x.tag] -= 1
        del stack[i:]

    def close(tags: frozenset, stop: frozenset) -> None:
        if not any(is_open.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                deeper = i
                while deeper > 1 and stack[deeper - 1].tag in tags:
                    deeper -= 1
                # the outermost of an unbroken run of those to close
                cut(deeper)
                return
            if stack[i].tag in stop or stack[i].tag in BARRIERS and stack[i].tag not in tags:
                return

    p_only = frozenset(["p"])
    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            text(html[pos:])
            break
        text(html[pos:at])
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        following = html[at + 1 : at + 2]
        if following in ("!", "?"):
            end = html.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        m = TAG.match(html, at)
        if m is None:
            head = html[at + 1 : at + 3].lstrip("/")
            if head[:1].isascii() and head[:1].isalpha():
                break  # a tag that never ends
            text("<")
            pos = at + 1
            continue
        pos = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not is_open.get("p"):
                stack[-1].children.append(Node("p"))
            elif is_open.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in BARRIERS and tag not in BARRIERS and tag not in ("tr", "tbody", "thead", "tfoot", "body"):
                        break
            continue
        if tag in CLOSES_P and len(stack) > 1:
            close(p_only, frozenset(["button"]))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        raw = m.group(3)
        attributes = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else None
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or raw.endswith("/") and (tag in ("svg", "math") or is_open.get("svg") or is_open.get("math")):
            continue
        if tag in RAW:
            end = END[tag].search(html, pos)
            piece = html[pos : end.start() if end else n]
            if tag == "textarea":
                node.children.append(unescape(piece))
            elif tag == "xmp":
                node.children.append(piece)
            pos = end.end() if end else n
            continue
        stack.append(node)
        is_open[tag] = is_open.get(tag, 0) + 1
    return root


class Writer:
    """Lines with collapsed spaces, pending margins and an indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.margin = 0
        self.indent: list[str] = []
        self.bullet = ""

    def write(self, s: str, pre: bool = False) -> None:
        if pre:
            pieces = s.replace("\r\n", "\n").split("\n")
            for i, piece in enumerate(pieces):
                if i:
                    self.newline(True)
                if piece:
                    self.put(piece)
            return
        s = COLLAPSE.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(self.line) and s == " "
            return
        if s[0] == " ":
            self.space = self.space or bool(self.line)
            s = s[1:]
        after = s[-1] == " "
        self.put(s[:-1] if after else s)
        self.space = after

    def put(self, s: str) -> None:
        if not self.line:
            if self.margin and self.lines:
                self.lines.extend([""] * (self.margin - 1))
            self.margin = 0
            levels = self.indent[:-1] if self.bullet else self.indent
            self.line.append("".join(levels[:INDENTS]) + self.bullet)
            self.bullet = ""
            self.space = False
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def newline(self, forced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif forced and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, margin: int) -> None:
        self.newline()
        self.margin = max(self.margin, margin)

    def text(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def seen(node: Node, shown: bool) -> bool | None:
    """Whether the node's own text is visible; None: it and all below are not rendered."""
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "dialog" and "open" not in a:
        return None
    if a:
        if "hidden" in a or node.tag == "input" and a.get("type") == "hidden":
            return None
        style = a.get("style")
        if style:
            if STYLE_NONE.search(style):
                return None
            if (m := STYLE_VISIBILITY.search(style)) is not None:
                return m.group(1).lower() == "visible"
    return shown


def cells(table: Node, shown: bool) -> list[list[tuple[Node, bool, int]]]:
    """Visible rows of (cell, whether shown, columns it spans); cells outside a row form one."""
    rows: list[list[tuple[Node, bool, int]]] = []
    loose: list[tuple[Node, bool, int]] = []

    def span(cell: Node) -> int:
        v = cell.attributes.get("colspan") or ""
        return max(1, min(1000, int(v))) if v.isascii() and v.isdigit() else 1

    for part in table.children:
        if isinstance(part, str):
            if not part.isspace():
                rows.append([(wrap(part), shown, 1)])
            continue
        see = seen(part, shown)
        if see is None:
            continue
        if part.tag in ("td", "th"):
            loose.append((part, see, span(part)))
            continue
        if loose:
            rows.append(loose)
            loose = []
        if part.tag in ("thead", "tbody", "tfoot"):
            rows += cells(part, see)
        elif part.tag == "tr":
            row = []
            for c in part.children:
                if isinstance(c, str):
                    if not c.isspace():
                        row.append((wrap(c), see, 1))
                elif (s := seen(c, see)) is not None:
                    row.append((c, s, span(c)))
            rows.append(row)
        elif part.tag not in ("col", "colgroup"):
            rows.append([(part, see, 1)])  # caption and content that doesn't belong in a table
    if loose:
        rows.append(loose)
    return rows


def wrap(s: str) -> Node:
    node = Node("span")
    node.children.append(s)
    return node


def number(v: str | None) -> int | None:
    """The integer that an attribute starts with."""
    m = INTEGER.match(v or "")
    return int(m.group(1)) if m and len(m.group(1)) < 10 else None


def input_text(node: Node) -> str:
    """What an input shows: its value or else its placeholder."""
    kind, value = node.attributes.get("type", "text").lower(), node.attributes.get("value") or ""
    kind = kind if kind in VALUE_SHOWN | PLACEHOLDER_SHOWN | HIDING_INPUTS else "text"
    if kind in VALUE_SHOWN and value:
        return value
    return (node.attributes.get("placeholder") or "") if kind in PLACEHOLDER_SHOWN and not value else ""


def table_lines(table: Node, shown: bool) -> list[str]:
    """The table with every column padded to its widest cell; what spans columns isn't counted.

    A cell that spans rows keeps its columns free in the rows below it.
    """
    grid: list[list[tuple[int, str, int]]] = []
    widths: dict[int, int] = {}
    below: dict[int, int] = {}  # column -> rows for which a cell from above holds it
    for row in cells(table, shown):
        out, at, holds = [], 0, {c: n - 1 for c, n in below.items() if n > 1}
        held = len(below)
        for c, s, n in row:
            while at in below:
                at += 1
            rows = number(c.attributes.get("rowspan")) if c.tag in ("td", "th") else None
            if rows is not None and (rows > 1 or rows == 0):
                holds.update(dict.fromkeys(range(at, at + n), min(rows - 1, 65534) if rows else 65534))
            out.append((at, " ".join(render(c, s, in_cell=True).split()), n))
            at += n
        below = {c: n for c, n in holds.items() if n > 0}
        if any(t for _, t, _ in out):
            grid.append(out)
            for k, t, n in out:
                if n == 1 and len(out) + held > 1:
                    widths[k] = max(widths.get(k, 0), len(t))
    # where each column starts, for as many columns as any cell stands in
    last = max((k for out in grid for k, _, _ in out), default=0)
    starts = [0]
    for k in range(last):
        starts.append(starts[-1] + widths.get(k, 0) + 2)
    lines = []
    for out in grid:
        line = ""
        for k, t, _ in out:
            gap = "  " if line or k else ""
            line = line.ljust(starts[k]) if len(line) + len(gap) <= starts[k] else line + gap
            line += t
        lines.append(line.rstrip())
    return lines


def render(root: Node, shown: bool = True, in_cell: bool = False) -> str:
    w = Writer()
    lists: list[tuple[int, int] | None] = []  # the next number of each open ordered list and its step, None for bullets
    pre = 0
    work: list[tuple] = [(root, shown, 0)]
    while work:
        node, shown, phase = work.pop()
        if isinstance(node, str):
            if shown:
                w.write(node, pre > 0)
            continue
        tag = node.tag
        if phase:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("li", "blockquote", "dd"):
                w.block(0)
                w.indent.pop()
                w.bullet = ""
            elif tag in ("pre", "textarea", "xmp"):
                pre -= 1
            if tag in BLOCK:
                w.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol")) else 1)
            continue
        if node is not root:
            see = seen(node, shown)
            if see is None:
                continue
            shown = see
        if tag == "br":
            w.newline(True)
            continue
        if tag == "input":
            if shown and (said := input_text(node)):
                w.write(said)
            continue
        if tag in BLOCK:
            w.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol")) else 1)
        elif tag in ("td", "th"):
            w.space = True
        if tag == "table" and not in_cell:
            for line in table_lines(node, shown):
                w.newline()
                w.put(line)
            w.block(2)
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            first = number(node.attributes.get("start"))
            back = "reversed" in node.attributes
            if first is None:
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
            lists.append((first, -1 if back else 1) if tag == "ol" else None)
        elif tag == "li":
            mark = "- "
            if lists and lists[-1] is not None:
                at, step = lists[-1]
                own = number(node.attributes.get("value"))
                at = at if own is None else own
                mark = f"{at}. "
                lists[-1] = (at + step, step)
            w.indent.append(" " * len(mark))
            w.bullet = mark
        elif tag in ("blockquote", "dd"):
            w.indent.append("  ")
        elif tag in ("pre", "textarea", "xmp"):
            pre += 1
        work.append((node, shown, 1))
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        work.extend((c, shown, 0) for c in reversed(children))
    return w.text()


def html_to_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id and the visible text of every row."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_to_text(h) for h in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return rows.mapInArrow(run, T.StructType([T.StructField("page_id", rows.schema["page_id"].dataType), T.StructField("text", T.StringType())]))
