"""HTML extraction by layout-aware rendering.

A tokeniser and a tree builder with implied end tags feed a renderer that follows the default display of
elements: it leaves out what is not visible, collapses white space as inline layout does, separates blocks,
numbers lists and aligns table cells in columns. All visible text is kept; nothing is scored or dropped as
boilerplate.

What hides an element: its tag, the `hidden` attribute, its own style, and rules of the page's `<style>` elements
for `display` and `visibility` with simple selectors: a tag, a class or an id, or a tag with one of these, in lists.
Rules with other selectors (more classes, combinators, attributes, states) and those within `@` blocks hide nothing:
their text stays. Linked sheets are not read, scripts not run.

Any page is drawn in time and space near its own size: no step recurses, open elements are found by their places,
and layout is given up, never text, where it would outgrow the text. Lines are indented for `INDENT` levels at
most; cells above `WIDE` characters don't widen their column; a table within `NESTED` others, one of a single
column, or one whose aligned form would be `SPREAD` times its text (and some) is written without alignment.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

from .storage import bounded_batches

# Fixed values of HTML: void elements, raw-text elements, elements that show nothing, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title template noscript iframe noembed noframes object audio video canvas datalist area base link meta param source track".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li legend listing main menu nav ol optgroup option p pre search section summary table caption ul xmp".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu blockquote pre listing xmp figure table hr fieldset".split())
PRE = frozenset("pre textarea listing xmp".split())
#: What an open head takes in, all of it hidden; any other element, or text, ends it.
IN_HEAD = frozenset("head base link meta title style script noscript noframes template".split())
#: What an opening tag closes, and the elements that such closing does not cross.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCK - {"html", "body", "option", "optgroup", "caption", "legend", "summary"}
P_SCOPE = frozenset("button td th caption table object template".split())
#: An end tag doesn't reach past these, unless it is one of the others.
BARRIER = frozenset("table td th caption template".split())
ENDS_ANYWHERE = frozenset("table tr thead tbody tfoot td th body html".split())

#: What of drawings and formulas is never drawn where it stands.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
FOREIGN = ("svg", "math")

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: An attribute: a name, which may begin with =, and a value; a quote counts only where a value begins.
_ONE = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)?"""
_TAG = re.compile(rf"</?[A-Za-z][^\s/>]*(?:[\s/]+|{_ONE})*+>?")
_OTHER = re.compile(r"<[!?][^>]*>?")
_START = re.compile(r"<(?=[!?]|/?[A-Za-z])")
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)?))?""")
_COMMENT_END = re.compile(r"--!?>")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: A style sheet's comments, blocks with their selectors, declarations, and selectors that are understood.
_REMARK = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_BRACE = re.compile(r"[{}]|@[^{};]*(?=\{)|[^{}@]+|@")
_STATED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
_SIMPLE = re.compile(r"([A-Za-z][\w-]*)?(?:([.#])(-?[A-Za-z_\u0080-\U0010ffff][\w-]*))?")
_WS = re.compile(r"[ \t\n\r\f]+")

INDENT, WIDE, NESTED, SPREAD = 16, 80, 4, 4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = ("thead", "tbody", "tfoot")
#: Inputs that show their value.
SHOWN_INPUTS = frozenset("text submit button reset search email url tel number".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Open:
    """The open elements, and where those of each tag are."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, to: int) -> None:
        for node in self.stack[to:]:
            self.places[node.tag].pop()
        del self.stack[to:]

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_after(self, tags: Iterable[str], place: int) -> int:
        """Place of the outermost of these tags inside `place`; 0 if there is none."""
        found = ((p, bisect_right(p, place)) for t in tags if (p := self.places.get(t)))
        return min((p[k] for p, k in found if k < len(p)), default=0)


def tree(html: str) -> Node:
    """The document's tree; unclosed, implied and misnested tags are resolved as they come."""
    root = Node("#document")
    sheets: list[Node] = []
    now = Open(root)
    stack = now.stack

    def end_head() -> None:
        while stack[-1].tag == "head":
            now.close(len(stack) - 1)

    def add_text(text: str) -> None:
        if text.strip(" \t\n\r\f"):
            end_head()
        stack[-1].children.append(text)

    at, end = 0, len(html)
    last_section = html.rfind("]]>")
    while at < end:
        m = _START.search(html, at)
        upto = m.start() if m else end
        if upto > at:
            add_text(unescape(html[at:upto]))
        if not m:
            break
        if html.startswith("<!--", upto):
            if html.startswith((">", "->"), upto + 4):  # empty
                at = html.index(">", upto + 4) + 1
            else:
                stop = _COMMENT_END.search(html, upto + 4)
                at = stop.end() if stop else end
            continue
        if upto < last_section and html.startswith("<![CDATA[", upto):
            stop = html.index("]]>", upto)
            stack[-1].children.append(html[upto + 9 : stop])
            at = stop + 3
            continue
        if html[upto + 1] in "!?":
            at = _OTHER.match(html, upto).end()
            continue
        token = _TAG.match(html, upto)[0]
        at = upto + len(token)
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            place = now.last((tag,))
            if not place:
                if tag == "p":
                    stack[-1].children.append(Node("p"))
            elif tag in ENDS_ANYWHERE or now.last(BARRIER) <= place:
                now.close(place)
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in CLOSES:
            closed, stop_at = CLOSES[tag]
            if place := now.first_after(closed, now.last(stop_at)):
                now.close(place)
        if tag in ENDS_P and (place := now.last(("p",))) > now.last(P_SCOPE):
            now.close(place)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            now.close(len(stack) - 1)
        node = Node(tag, attributes(token[1 + len(tag) :].removesuffix(">")))
        foreign = tag in FOREIGN or any(now.places.get(t) for t in FOREIGN)
        if foreign and tag in UNDRAWN:
            node.attrs["hidden"] = ""
        if foreign and tag == "text":
            stack[-1].children.append(" ")  # drawn at a place of its own
        stack[-1].children.append(node)
        if tag in VOID or foreign and token.endswith("/>"):
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            if tag == "style":
                sheets.append(node)
            at = end if not stop else (html.find(">", stop.end()) + 1 or end)
            continue
        now.push(node)
    if sheets:
        apply_sheets(root, sheets)
    return root


def sheet_rules(css: str) -> Iterator[tuple[tuple[str, str], str, tuple[bool, int], str]]:
    """((tag, class or id with its sign), property, (important, weight), value) of the rules that are understood, in order."""
    depth, at_rule, selectors = 0, 0, ""
    for m in _BRACE.finditer(_REMARK.sub(" ", css)):
        part = m[0]
        if part == "{":
            depth += 1
        elif part == "}":
            depth = max(0, depth - 1)
            if depth < at_rule:
                at_rule = 0
            selectors = ""
        elif part.startswith("@") and part != "@":
            at_rule = at_rule or depth + 1
        elif not at_rule and depth == 0:
            selectors = part.rpartition(";")[2]
        elif not at_rule and depth == 1 and ("isplay" in part or "isibility" in part or "DISPLAY" in part or "VISIBILITY" in part):
            stated = [(p[0].lower(), bool(p[2]), p[1].lower()) for p in _STATED.findall(part)]
            for selector in selectors.split(","):
                simple = _SIMPLE.fullmatch(selector.strip())
                if simple and simple[0]:
                    key = (simple[1] or "").lower(), f"{simple[2]}{simple[3]}" if simple[2] else ""
                    weight = (100 if simple[2] == "#" else 10 if simple[2] else 0) + bool(simple[1])
                    for name, important, value in stated:
                        yield key, name, (important, weight), value


def apply_sheets(root: Node, sheets: list[Node]) -> None:
    """Put what style elements say of display and visibility into the elements' own styles; these win if they say it too."""
    rules: dict[tuple[tuple[str, str], str], tuple[tuple[bool, int], int, str]] = {}
    stated = (rule for sheet in sheets for rule in sheet_rules("".join(c for c in sheet.children if isinstance(c, str))))
    for turn, (key, name, weight, value) in enumerate(stated):
        if (key, name) not in rules or rules[key, name][0] <= weight:
            rules[key, name] = weight, turn, value
    work = [root] if rules else []
    while work:
        node = work.pop()
        work.extend(c for c in node.children if isinstance(c, Node))
        marks = ["", *(f".{c}" for c in dict.fromkeys(node.attrs.get("class", "").split())), *([f"#{node.attrs['id']}"] if node.attrs.get("id") else [])]
        for name in ("display", "visibility"):
            found = [rules[k] for mark in marks for tag in ("", node.tag) if (k := ((tag, mark), name)) in rules]
            if found:
                (important, _), _, value = max(found)
                own = node.attrs.get("style", "")
                said = any(p[0].lower() == name for p in _STATED.findall(own))
                if important or not said:
                    if name == "display" and said:
                        own = re.sub(r"(^|;)\s*display\s*:[^;]*", r"\1", own, flags=re.I)
                    node.attrs["style"] = f"{own};{name}:{value}"


def displayed(node: Node) -> bool:
    """Whether a node has a place in the layout, itself and all below it."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return "style" not in a or not _NONE.search(a["style"])


def shown(node: Node, inherited: bool) -> bool:
    """Whether a node's text is visible: what its style says, else what holds around it."""
    stated = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return stated[-1].lower() == "visible" if stated else inherited


class Canvas:
    """Lines of text under construction, with pending white space and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        #: Whether the open line holds more than its prefix, and doesn't end in a space.
        self.solid = False
        self.blank = 0
        self.prefix: list[str] = []
        self.lists = 0
        #: What the next line starts with in place of the prefixes: a list item's marker.
        self.first: str | None = None

    def margin(self, but: int = 0) -> str:
        return "".join(self.prefix[: min(INDENT, len(self.prefix) - but)])

    def text(self, s: str) -> None:
        for i, part in enumerate(_WS.split(s)):
            self.space |= i > 0
            if part:
                self._start()
                if self.space and self.solid:
                    self.parts.append(" ")
                self.parts.append(part)
                self.space, self.solid = False, True

    def _start(self) -> None:
        if not self.parts:
            if self.lines:
                self.lines.extend([""] * self.blank)
            self.blank = 0
            self.parts.append(self.margin() if self.first is None else self.first)
            self.first = None
            self.space = self.solid = False

    def literal(self, s: str) -> None:
        for k, row in enumerate(s.split("\n")):
            if k:
                self.newline(keep=True)
            if row:
                self._start()
                self.parts.append(row)
                self.solid = not row.endswith(" ")

    def newline(self, keep: bool = False) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
        elif keep and self.lines:
            self.blank = min(self.blank + 1, 2**20)
        self.parts, self.space, self.solid = [], False, False

    def block(self, gap: int) -> None:
        self.newline()
        self.blank = max(self.blank, gap)

    def result(self) -> str:
        self.newline()
        return "\n".join(self.lines)


class Grid:
    """A table being laid out: cells by row and column, and the columns that cells of rows above reach into."""

    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.ends: list[int] = []
        self.reach: list[tuple[int, int, int]] = []
        self.column = self.seen = 0

    def row(self) -> None:
        self.rows.append({})
        self.ends.append(0)
        self.reach = sorted(x for x in self.reach if x[2] > len(self.rows) - 1)
        self.column = self.seen = 0

    def place(self, across: int, down: int) -> int:
        """The column of the row's next cell, the first that is free."""
        while self.seen < len(self.reach) and self.reach[self.seen][0] <= self.column:
            self.column = max(self.column, self.reach[self.seen][1])
            self.seen += 1
        at = self.column
        if down > 1:
            self.reach.append((at, at + across, len(self.rows) - 1 + down))
        self.column = self.ends[-1] = at + across
        return at

    def lines(self) -> Iterator[str]:
        widths: dict[int, int] = {}
        for cells in self.rows:
            for c, lines in cells.items():
                widths[c] = max(widths.get(c, 0), max((n for x in lines if (n := len(x)) <= WIDE), default=0))
        columns = sorted(widths)
        heights = [max(map(len, cells.values()), default=0) for cells in self.rows]
        text = sum(len(x) for cells in self.rows for lines in cells.values() for x in lines)
        aligned = sum(heights) * sum(w + 3 for w in widths.values()) <= SPREAD * text + 4000
        for cells, height, last in zip(self.rows, heights, self.ends, strict=True):
            here = columns[: bisect_left(columns, last)] if aligned else sorted(cells)
            for k in range(height):
                parts = [cells[c][k] if c in cells and k < len(cells[c]) else "" for c in here]
                line = " | ".join([p.ljust(widths[c]) for p, c in zip(parts, here, strict=True)] if aligned else [p for p in parts if p]).rstrip()
                if line.strip(" |"):
                    yield line


def _number(value: str, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value)
    return int(m[1]) if m else default


def _elements(node: Node, *tags: str) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.tag in tags and displayed(c)]


def _rows(table: Node) -> list[Node]:
    """The table's own rows: head sections first, then bodies, then feet; nested tables keep theirs."""
    parts: dict[str, list[Node]] = {name: [] for name in SECTIONS}
    for child in _elements(table, "tr", *SECTIONS):
        parts["tbody" if child.tag == "tr" else child.tag].extend([child] if child.tag == "tr" else _elements(child, "tr"))
    return [row for rows in parts.values() for row in rows]


class Renderer:
    """Draws a tree with a stack of steps, so that nothing recurses; each table's cells are drawn on canvases of their own."""

    def __init__(self) -> None:
        self.canvas = Canvas()
        self.outer: list[Canvas] = []
        self.work: list[tuple[Callable[..., None], tuple]] = []

    def then(self, *steps: tuple) -> None:
        """Do these next, in order: (function, arguments...)."""
        self.work.extend((s[0], s[1:]) for s in reversed(steps))

    def run(self, root: Node) -> str:
        self.then((self.kids, root.children, False, True))
        while self.work:
            step, args = self.work.pop()
            step(*args)
        return self.canvas.result()

    def kids(self, children: list[Node | str], pre: bool, seen: bool) -> None:
        self.work.extend((self.open, (c, pre, seen)) for c in reversed(children))

    def block(self, gap: int) -> None:
        self.canvas.block(gap)

    def text(self, s: str, seen: bool) -> None:
        if seen:
            self.canvas.text(s)

    def open(self, node: Node | str, pre: bool, seen: bool) -> None:
        canvas = self.canvas
        if isinstance(node, str):
            if seen:
                canvas.literal(node) if pre else canvas.text(node)
            return
        if not displayed(node):
            return
        tag, attrs = node.tag, node.attrs
        seen = shown(node, seen)
        if tag == "br":
            canvas.newline(keep=True)
        elif tag == "hr":
            canvas.block(1)
        elif tag == "img":
            self.text(attrs.get("alt", ""), seen)
        elif tag == "input":
            if attrs.get("type", "text").lower() in SHOWN_INPUTS:
                self.text(f" {attrs.get('value', '')} ", seen)
        elif tag == "table":
            self.table(node, pre, seen)
        elif tag not in ("wbr", "rp"):
            self.element(node, pre, seen)

    def element(self, node: Node, pre: bool, seen: bool) -> None:
        canvas, tag, attrs = self.canvas, node.tag, node.attrs
        before: list[tuple] = []
        after: list[tuple] = []
        if tag in LISTS:
            n, step = _number(attrs.get("start", ""), 1), -1 if "reversed" in attrs else 1
            for child in _elements(node, "li"):
                n = _number(child.attrs.get("value", ""), n)
                child.attrs["#mark"] = f"{n}. " if tag == "ol" else "- "
                n += step
        if tag in BLOCK:
            gap = int(tag in SPACED and not (tag in LISTS and canvas.lists))
            canvas.block(gap)
            after = [(self.block, gap)]
        if tag in ("li", "dd", "blockquote"):
            if tag == "li":
                canvas.first = canvas.margin() + attrs.get("#mark", "- ")
            canvas.prefix.append("> " if tag == "blockquote" else "  ")
            canvas.lists += tag != "blockquote"
            after.insert(0, (self.leave, tag))
        if tag == "q":
            before, after = [(self.text, "“", seen)], [(self.text, "”", seen), *after]
        if tag in ("td", "th", "button", "option", "label") and canvas.parts:
            canvas.space = True
        inner = pre or tag in PRE or "white-space:pre" in attrs.get("style", "").replace(" ", "").lower()
        children = _elements(node, "summary")[:1] if tag == "details" and "open" not in attrs else node.children
        self.then(*before, (self.kids, children, inner, seen), *after)

    def leave(self, tag: str) -> None:
        self.canvas.newline()
        self.canvas.prefix.pop()
        self.canvas.lists -= tag != "blockquote"
        self.canvas.first = None

    def table(self, table: Node, pre: bool, seen: bool) -> None:
        """Caption and stray content, then rows; a span leaves its columns empty."""
        self.canvas.block(1)
        sections = [table, *_elements(table, *SECTIONS)]
        stray = [c for c in table.children if isinstance(c, str) or c.tag not in ("tr", "colgroup", "col", *SECTIONS)]
        stray += [c for s in sections[1:] for c in s.children if isinstance(c, str) or c.tag != "tr"]
        steps = [s for c in stray if not isinstance(c, str) or c.strip() for s in ((self.open, c, pre, seen), (self.block, 0))]
        rows = [(row, [c for c in row.children if (c.strip() if isinstance(c, str) else displayed(c))]) for row in _rows(table)]
        if len(self.outer) >= NESTED or all(len(cells) < 2 for _, cells in rows):
            steps += [s for row, cells in rows for c in cells for s in ((self.open, c, pre, shown(row, seen)), (self.block, 0))]
        else:
            grid = Grid()
            for row, cells in rows:
                steps.append((grid.row,))
                steps += [(self.cell, grid, c, pre, shown(row, seen)) for c in cells]
            steps.append((self.lay_out, grid))
        self.then(*steps, (self.block, 1))

    def cell(self, grid: Grid, cell: Node | str, pre: bool, seen: bool) -> None:
        if isinstance(cell, str):
            if seen:
                grid.rows[-1].setdefault(grid.column, []).append(" ".join(cell.split()))
                grid.ends[-1] = max(grid.ends[-1], grid.column + 1)
            return
        across, down = (min(max(_number(cell.attrs.get(name, ""), 1), 1), 1000) for name in ("colspan", "rowspan"))
        at = grid.place(across, down)
        self.outer.append(self.canvas)
        self.canvas = Canvas()
        own = cell.tag in ("td", "th")
        self.then((self.kids, cell.children if own else [cell], pre, shown(cell, seen) if own else seen), (self.end_cell, grid, at))

    def end_cell(self, grid: Grid, at: int) -> None:
        self.canvas.newline()
        grid.rows[-1].setdefault(at, []).extend([x for x in self.canvas.lines if x.strip()] or [""])
        self.canvas = self.outer.pop()

    def lay_out(self, grid: Grid) -> None:
        for line in grid.lines():
            self.canvas.literal(line)
            self.canvas.newline()


def render(html: str) -> str:
    """All visible text of a page."""
    return Renderer().run(tree(html))


def title(html: str) -> str | None:
    """The text of the first title element."""
    m = re.search(r"<title[^>]*>(.*?)(?:</title|\Z)", html, re.S | re.I)
    return " ".join(unescape(m[1]).split()) if m else None


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, title, text, n_chars, n_lines), one row per row of `pages`.

    Null html: null title and text, counts 0. Empty html: empty text. Repeated rows stay repeated, equal pages
    give equal text, an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [render(h) if isinstance(h, str) else None for h in pdf["html"]]
            yield pd.DataFrame(
                {
                    "page_id": pdf["page_id"], "url": pdf["url"], "title": [title(h) if isinstance(h, str) else None for h in pdf["html"]], "text": texts,
                    "n_chars": [len(t or "") for t in texts], "n_lines": [len(t.split("\n")) if t else 0 for t in texts],
                }
            )

    bounded_batches(pages)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {kind}, url string, title string, text string, n_chars long, n_lines long")
