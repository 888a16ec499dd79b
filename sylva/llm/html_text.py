"""Layout-aware text of HTML pages.

A tokenizer (tags, comments, raw text elements) feeds a tree builder that knows
implied tags: ``p``, ``li``, ``tr``, ``td``, ``option`` ... close by themselves, an end
tag closes what is open inside it, rows get a table. The renderer walks the tree
without recursion: invisible elements (head, script, style, template, closed dialogs,
``hidden``, ``display:none``, ``visibility:hidden`` ...) give nothing; inline text has its
white space collapsed; blocks start a line, paragraphs and the like leave a blank
line; lists are indented, numbered or bulleted; ``pre`` and ``textarea`` keep their space;
options, buttons and the values of fields are text; a table's cells are padded to
the width of their column, with ``colspan`` and ``rowspan``. Layout has bounds, text has none:
indents of MAX_INDENT levels, columns padded to MAX_PAD characters, spans over MAX_COLUMNS columns at most.

Quotes count only right after ``=`` in a tag; a page whose quotes hide its last ``>`` is read
without them from there. Time is linear in a page's length: open elements are found by tag, not by a walk.

Null and empty pages give an empty text; broken mark-up never fails. Pages of any
length and depth are rendered whole. Repeated rows get equal rows. An empty table gives no rows.
Only page_id and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from sylva.llm.common import arrow_map

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript iframe object datalist audio video canvas title noembed noframes desc metadata defs".split())
#: Kinds of ``input`` that show their value.
OTHER_INPUTS = set("hidden password checkbox radio file image color range".split())
SHOWN = set("text search email url tel number submit button reset date month week time datetime-local".split())
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option optgroup textarea dialog select".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: An open element of the key ends at a start tag of its set.
ENDS = {
    "p": set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "tfoot": {"tbody"},
    "head": {"body"}, "caption": {"tr", "tbody", "thead", "tfoot", "td", "th"},
}
#: An implied end doesn't reach beyond these.
SCOPE = {"table", "td", "th", "caption", "html", "ul", "ol", "dl", "select", "template"}

#: What starts at a ``<``: a comment or declaration, or a tag; the second form takes no account of quotes.
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*>?", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?>=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
MAX_INDENT, MAX_PAD, MAX_COLUMNS = 40, 80, 64
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


#: For a start tag, the open elements that it may end.
ENDED = {t: [k for k, tags in ENDS.items() if t in tags] for t in set().union(*ENDS.values())}
CELLS, ROWS = ("table", "td", "th"), ("tr", "tbody", "thead", "tfoot")


class _Open:
    """The stack of open elements, with the depths of each tag."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def deepest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def imply(self, tag: str) -> None:
        """Close what the start tag ends: the deepest such element, if no scope lies above it, and so on."""
        may = ENDED.get(tag)
        while may and (depth := self.deepest(may)):
            # cells and captions that the tag ends are no scope for it; they are the candidates themselves
            if self.scopes and self.scopes[-1] > depth:
                return
            self.cut(depth)


def parse(page: str) -> Node:
    root = Node("html")
    open_ = _Open(root)
    stack = open_.stack

    def start(tag: str, attrs: dict) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in stack[:3]):
            return
        open_.imply(tag)
        if tag in ("td", "th") and stack[-1].tag not in ("tr",):
            start("tr", {})
        if tag in ROWS and not open_.at.get("table"):
            start("table", {})
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            open_.push(node)

    def end(tag: str) -> None:
        depth = open_.deepest([tag])
        wall = 0 if tag in ("table", *ROWS, "body", "html") else open_.deepest(CELLS)
        if depth and depth >= wall:
            open_.cut(depth)
        elif not wall and tag in ("p", "br"):
            start(tag, {})
            if tag == "p":
                open_.cut(len(stack) - 1)

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s))

    at, tag_of, last = 0, TAG, page.rfind(">")
    plain = 0  # the start of the text that isn't put out yet
    while True:
        here = page.find("<", at)
        if here < 0:
            break
        m = OTHER.match(page, here) if page[here + 1 : here + 2] in ("!", "?") or (page[here + 1 : here + 2] == "/" and not page[here + 2 : here + 3].isalpha()) else None
        if m is None and here < last:
            m = tag_of.match(page, here)
            if m is None and tag_of is TAG and page[here + 1 : here + 2] and (page[here + 1].isalpha() or page[here + 1] == "/"):
                m = BARE.match(page, here)
                if m is not None:  # quotes hide every > from here to the end
                    tag_of = BARE
        if m is None:
            at = here + 1
            continue
        text(page[plain:here])
        at = plain = m.end()
        if m.re is OTHER:
            continue
        tag = m[2].lower()
        if m[1]:
            end(tag)
            continue
        attrs: dict[str, str] = {}
        for k, a, b, c in ATTRIBUTE.findall(m[3]) if m[3] and m[3] != "/" else ():
            attrs.setdefault(k.lower(), html.unescape(a or b or c))
        start(tag, attrs)
        if tag in RAW and stack[-1].tag == tag:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            body = page[at : stop.start() if stop else len(page)]
            stack[-1].children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            open_.cut(len(stack) - 1)
            at = plain = stop.end() if stop else len(page)
    text(page[plain:])
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return False
    style = node.attrs.get("style")
    return not style or not re.search(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", style, re.I)


class _Text:
    """Lines of output with block spacing. ``levels`` are the indents of open lists and quotes."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent, self.first, self.gap, self.depth = "", "", 0, 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for x in rest:
                self.end(keep=True)
                self.parts.append(x)
            return
        s = SPACES.sub(" ", s)
        if not self.parts or self.parts[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.parts.append(s)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one counts only with ``keep``."""
        body = "".join(self.parts).rstrip(" ")
        self.parts = []
        if not body and not keep and not self.first:
            return
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.lines.append((self.first or self.indent) + body if body or self.first else "")
        self.first = ""

    def block(self, spaced: bool) -> None:
        if any(x.strip(" ") for x in self.parts):
            self.end()
        self.parts = []
        if spaced:
            self.gap = 2
        else:
            self.gap = max(self.gap, 1)

    def deeper(self, by: str):
        """Indent by one level; the result puts the indent back."""
        was, self.depth = self.indent, self.depth + 1
        if self.depth <= MAX_INDENT:
            self.indent = was + by

        def back() -> None:
            self.indent, self.depth = was, self.depth - 1

        return back


def render(root: Node) -> str:
    """All visible text. An explicit stack replaces recursion, so depth is no limit."""
    out = _Text()
    stack: list[tuple] = [("node", root, False)]
    tables: list[dict] = []
    outputs = [out]
    lists: list[list] = []
    while stack:
        kind, what, pre = stack.pop()
        out = outputs[-1]
        if kind == "text":
            out.text(what, pre)
        elif kind == "call":
            what()
        elif visible(what):
            tag = what.tag
            if tag == "br":
                out.end(keep=True)
                continue
            if tag == "hr":
                out.block(False)
                out.parts = ["---"]
                out.block(False)
                continue
            if tag == "img":
                out.text(what.attrs.get("alt", ""), False)
                continue
            if tag == "input":
                kind = what.attrs.get("type", "text").lower()
                out.text(what.attrs.get("value", "") if kind in SHOWN or kind not in OTHER_INPUTS else "", False)
                continue
            if tag in VOID:
                continue
            pre = pre or tag in ("pre", "textarea")
            block = tag in BLOCKS
            spaced = tag in SPACED and not (tag in ("ul", "ol") and lists)
            if tag == "table":
                out.block(True)
                tables.append([])
                stack.append(("call", lambda: _table(outputs[-1], tables.pop()), False))
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                outputs.append(_Text())
                spans = [max(1, _number(what.attrs.get(k))) for k in ("colspan", "rowspan")]
                stack.append(("call", lambda row=tables[-1][-1], spans=spans: row.append((_lines(outputs.pop()), *spans)), False))
            elif tag in ("ul", "ol"):
                out.block(spaced)
                lists.append([tag, _number(what.attrs.get("start"))])
                stack.append(("call", lambda out=out, spaced=spaced: (out.block(spaced), lists.pop()), False))
            elif tag == "li":
                out.block(False)
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                if out.first:
                    out.end()
                out.first = out.indent + mark
                back = out.deeper(" " * len(mark))
                stack.append(("call", lambda out=out, back=back: (out.end() if out.parts or out.first else None, back()), False))
            elif block:
                out.block(spaced)
                if tag == "option" and what.attrs.get("label") and not what.children:
                    out.text(what.attrs["label"], False)
                if tag == "optgroup":
                    out.text(what.attrs.get("label", ""), False)
                    out.block(False)
                back = out.deeper("  ") if tag in ("blockquote", "dd") else None
                stack.append(("call", lambda out=out, back=back, spaced=spaced: (out.block(spaced), back and back()), False))
            for child in reversed(what.children):
                stack.append(("text", child, pre) if isinstance(child, str) else ("node", child, pre))
    return "\n".join(_lines(outputs[0]))


def _number(s: str | None) -> int:
    return int(s) if s and re.fullmatch(r"-?\d{1,9}", s) else 1


def _lines(out: _Text) -> list[str]:
    out.block(False)
    lines = out.lines
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _table(out: _Text, table: list) -> None:
    """Cells padded to their column's width; a cell of several lines takes as many lines of the row.

    A cell stands in the first free column; its ``colspan`` and ``rowspan`` take columns from the cells after and below it.
    """
    out.block(False)  # text of the table outside its cells comes first
    rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines)
    taken: dict[int, int] = {}  # column -> rows that it is still taken for
    for row in (r for r in table if r):
        placed, at, fresh = [], 0, {}
        for lines, across, down in row:
            while taken.get(at):
                placed.append((at, 1, []))
                at += 1
            across = min(across, max(1, MAX_COLUMNS - at))
            placed.append((at, across, lines))
            if down > 1:
                fresh |= {c: down for c in range(at, at + across) if c < MAX_COLUMNS}
            at += across
        placed += [(c, 1, []) for c in sorted(taken) if c >= at]
        taken = {c: n - 1 for c, n in (taken | fresh).items() if n > 1}
        rows.append(placed)
    widths: dict[int, int] = {}
    for row in rows:
        for column, across, lines in row:
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(MAX_PAD, max(map(len, lines), default=0)))
    for row in rows:
        pad = [sum(widths.get(c, 0) for c in range(column, column + across)) + 3 * (sum(c in widths for c in range(column, column + across)) or 1) - 3 for column, across, _ in row]
        for k in range(max(1, max(len(lines) for _, _, lines in row))):
            line = " | ".join((lines[k] if k < len(lines) else "").ljust(w) for (_, _, lines), w in zip(row, pad, strict=True))
            if line.strip(" |"):
                out.parts = [line]
                out.end()
            out.parts = []
    out.block(True)


def page_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every page."""

    def run(batches):
        for b in batches:
            texts = [page_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return arrow_map(pages.select("page_id", "html"), run, "page_id long, text string, n_chars long, n_lines long")
