"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a renderer that keeps block spacing, lists and aligned table cells.

The tokenizer and builder are linear in the page; nesting beyond MAX_DEPTH continues at that depth, as in browsers (text is kept), so no page exhausts the stack.
Every table cell begins at its column. Columns are as wide as their widest line up to PAD characters; where a line of a cell is longer, the cells to its right begin
below it, so that one huge cell neither inflates every row nor pushes others out of their columns. Only columns that would begin beyond WIDE characters follow there, parted by two spaces.

A line is written once, whatever it is nested in; only cells are laid out by themselves. Columns count wide East Asian characters twice.

Visibility: display:none and the hidden attribute end a subtree; visibility:hidden is inherited until a descendant is visible again. Labels in svg, the content of objects and
the values of buttons and text fields are visible text; of closed details the summary is, of ruby text all but the parentheses.

Defined results: null and empty pages give the empty text. Malformed markup never fails: what can't be a tag is text, open elements end with the page.
Only id and html columns are read. Repeated rows give repeated rows.
"""

from __future__ import annotations

import bisect
import heapq
import html as entities
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship

MAX_DEPTH = 512
PAD = 48
WIDE = 1000

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("rp head script style template noscript iframe noembed noframes audio video canvas datalist title meta link desc defs symbol metadata clippath mask".split())
SHOWN_VALUES = frozenset("submit button reset text search email url tel number date".split())  # input types whose value is seen
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main menu nav section summary tr thead tbody tfoot caption td th option optgroup search".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag ends open elements of the second set, looked for up to one of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
}
SCOPE = frozenset("table td th caption template html".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
_RIGHT = re.compile(r"(?:^|;)\s*text-align\s*:\s*(?:right|end)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "off")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.off = tag, attrs, [], False

    def attr(self, name: str) -> str | None:
        """None if absent; the first of a name counts."""
        if name in self.attrs.lower():
            for m in _ATTR.finditer(self.attrs):
                if m[1].lower() == name:
                    return entities.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kind is text, start or end."""
    at, n, dry = 0, len(page), {}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = -1 if "-->" in dry else page.find("-->", lt + 4)
            if end < 0:
                dry["-->"] = True
                return  # an open comment hides the rest
            at = end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := _NAME.match(page, lt + 1 + (nxt == "/")):
            p = m.end()
            while (s := _STOP.search(page, p)) and s[0] != ">":
                q = -1 if s[0] in dry else page.find(s[0], s.end())
                if q < 0:
                    dry[s[0]] = True
                p = s.end() if q < 0 else q + 1
            if s is None:
                return  # an open tag hides the rest
            name = m[0].lower()
            attrs = page[m.end() : s.start()]
            at = s.end()
            if nxt == "/":
                yield "end", name, ""
                continue
            yield "start", name, attrs
            if name in RAW or name in RCDATA:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at) if name not in dry else None
                if end is None:
                    dry[name] = True
                body = page[at : end.start() if end else n]
                if body:
                    yield ("text" if name in RCDATA else "raw"), body, ""
                at = end.start() if end else n
        else:
            yield "text", "<", ""
            at = lt + 1


def build(page: str) -> Node:
    root = Node("html")
    stack = [root]

    def push(name: str, attrs: str = "") -> None:
        node = Node(name, attrs)
        if len(stack) >= MAX_DEPTH and name not in VOID:
            last = stack.pop()
            node.off = last.off or hidden(last)
        stack[-1].kids.append(node)
        if name not in VOID:
            stack.append(node)

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        """End the outermost open element of `names` below the nearest of `stop`."""
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in names:
                cut = i
        if cut is not None:
            del stack[cut:]

    for kind, name, attrs in tokens(page):
        if kind == "text":
            stack[-1].kids.append(entities.unescape(name))
        elif kind == "start":
            if name == "html":
                continue
            if name == "body":
                close(frozenset(["head"]), frozenset())
            if name in CLOSES_P:
                close(frozenset(["p"]), SCOPE | {"button"})
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name == "tr" and stack[-1].tag == "table":
                push("tbody")
            if name in ("td", "th"):
                if stack[-1].tag == "table":
                    push("tbody")
                if stack[-1].tag in ("tbody", "thead", "tfoot"):
                    push("tr")
            if stack[-1].tag == "head" and name in BLOCKS:
                stack.pop()  # a head without an end
            push(name, attrs)
        elif kind == "end":
            if name in ("p", "br") and not any(x.tag == name for x in stack):
                push(name)
                if name == "p":
                    stack.pop()
                continue
            stop = SCOPE - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") else frozenset(["table"]) - {name}
            names = HEADINGS if name in HEADINGS else {name}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    del stack[i:]
                    break
                if stack[i].tag in stop:
                    break
    return root


def hidden(n: Node) -> bool:
    if n.off or n.tag in HIDDEN:
        return True
    if not n.attrs:
        return n.tag == "dialog"
    if n.attr("hidden") is not None or (n.tag == "dialog" and n.attr("open") is None) or (n.tag == "input" and (n.attr("type") or "").lower() == "hidden"):
        return True
    style = n.attr("style")
    return bool(style and _NONE.search(style))


def seen(n: Node, above: bool) -> bool:
    """Whether text of an element is visible, by its last visibility rule or the element's above it."""
    rules = _SEEN.findall(n.attr("style") or "") if n.attrs else ()
    return rules[-1].lower() == "visible" if rules else above


def cells_wide(s: str) -> int:
    """Columns that a text takes up: wide East Asian characters two, marks on others none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines of text with pending blank lines; inline text gathers until a block begins or ends. Blocks that are set in share the page: a line is written once, behind the
    indent of all blocks around it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.floor = 0  # where the innermost block that is set in begins
        self.indent = ""
        self.mark: str | None = None  # what stands before the next line instead of the indent

    def text(self, s: str, pre: bool) -> None:
        if pre:
            head, *rest = s.split("\n")
            self.run.append(head)
            for x in rest:
                self.flush(True)
                self.run.append(x)
        else:
            self.run.append(_SPACE.sub(" ", s))

    def flush(self, pre: bool = False) -> None:
        s = "".join(self.run)
        self.run = []
        s = s.rstrip() if pre else _SPACE.sub(" ", s).strip(" ")
        if s or (pre and len(self.lines) > self.floor):
            self.line(s)

    def part(self) -> None:
        """A blank line is due, but not at the beginning of a block that is set in."""
        if len(self.lines) > self.floor:
            self.gap = True

    def line(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent if self.mark is None else self.mark) + s if s else "")
        if s:
            self.mark = None

    def block(self, lines: list[str]) -> None:
        for x in lines:
            self.line(x)

    def enter(self, mark: str) -> tuple[int, str, str | None]:
        """Begin a block that is set in behind a mark; returns what leave() needs."""
        was = (self.floor, self.indent, self.mark)
        self.mark = (self.indent if self.mark is None else self.mark) + mark
        self.indent += " " * len(mark)
        self.floor = len(self.lines)
        return was

    def leave(self, was: tuple[int, str, str | None], pre: bool = False) -> None:
        self.flush(pre)
        if len(self.lines) > self.floor:
            self.gap, mark = False, None  # what is due inside isn't due behind
        else:
            mark = was[2]
        self.floor, self.indent, self.mark = was[0], was[1], mark


def render(n: Node, out: Page, pre: bool = False, see: bool = True, drawn: bool = False) -> None:
    """see: text of n itself is visible; drawn: n is inside an svg, where only text elements show text."""
    summary = next((k for k in n.kids if isinstance(k, Node) and k.tag == "summary"), None) if n.tag == "details" and n.attr("open") is None else n
    for k in n.kids if summary is n else [summary] if summary else []:
        if isinstance(k, str):
            if see and not drawn:
                out.text(k, pre)
            continue
        if hidden(k):
            continue
        eye = seen(k, see)
        if k.tag == "br":
            out.flush(pre)
        elif k.tag == "input":
            value = k.attr("value") if eye and (k.attr("type") or "text").strip().lower() in SHOWN_VALUES else None
            if value:
                out.text(f" {value} ", pre)
        elif k.tag == "svg" or drawn:
            if k.tag == "text":
                out.flush(pre)
            render(k, out, pre, eye, k.tag not in ("text", "tspan", "textpath", "a", "foreignobject") or (drawn and k.tag == "a"))
            if k.tag == "text":
                out.flush(pre)
        elif k.tag == "table":
            out.flush(pre)
            out.part()
            out.block(table(k, eye))
            out.part()
        elif k.tag in ("ul", "ol", "menu"):
            out.flush(pre)
            nested = n.tag == "li"
            if not nested:
                out.part()
            items(k, out, eye)
            if not nested:
                out.part()
        elif k.tag in BLOCKS:
            out.flush(pre)
            if k.tag in PARAGRAPHS:
                out.part()
            if k.tag in ("blockquote", "dd"):
                was = out.enter("  ")
                render(k, out, pre, eye)
                out.leave(was, pre)
            else:
                render(k, out, pre or k.tag == "pre", eye)
                out.flush(pre or k.tag == "pre")
            if k.tag in PARAGRAPHS:
                out.part()
        else:
            render(k, out, pre or k.tag in ("textarea", "xmp"), eye)


def boxed(n: Node, pre: bool = False, see: bool = True) -> list[str]:
    """The lines of an element by itself."""
    sub = Page()
    render(n, sub, pre, see)
    sub.flush(pre)
    return sub.lines


def alone(kid: Node | str, see: bool) -> list[str]:
    holder = Node("div")
    holder.kids = [kid]
    return boxed(holder, see=see)


def whole(v: str | None) -> int | None:
    return int(v) if v and re.fullmatch(r"\s*[-+]?\d{1,9}\s*", v) else None


def items(n: Node, out: Page, see: bool) -> None:
    """The items of a list, behind their marks: numbers by start, value and reversed, or hyphens."""
    shown = [k for k in n.kids if (k.strip() if isinstance(k, str) else not hidden(k))]
    back = n.tag == "ol" and n.attr("reversed") is not None
    number = whole(n.attr("start")) if n.tag == "ol" else None
    if number is None:
        number = sum(isinstance(k, Node) and k.tag == "li" for k in shown) if back else 1
    for k in shown:
        if isinstance(k, Node) and k.tag == "li":
            if n.tag == "ol":
                own = whole(k.attr("value")) if k.attrs else None
                number = number if own is None else own
            was = out.enter(f"{number}. " if n.tag == "ol" else "- ")
            number += -1 if back else 1
            render(k, out, False, seen(k, see))
        elif isinstance(k, Node) and k.tag in ("ul", "ol", "menu"):
            was = out.enter("  ")
            items(k, out, seen(k, see))
        else:
            was = out.enter("")
            holder = Node("div")
            holder.kids = [k]
            render(holder, out, False, see)
        out.leave(was)


def span(cell: Node, name: str, most: int) -> int:
    v = cell.attr(name) if cell.attrs else None
    return min(max(int(v), 1), most) if v and v.strip().isdigit() and len(v.strip()) < 9 else 1


def rightmost(cell: Node) -> bool:
    """Whether a cell's text stands at the right of its column."""
    if not cell.attrs:
        return False
    return (cell.attr("align") or "").strip().lower() == "right" or bool(_RIGHT.search(cell.attr("style") or ""))


class Grid:
    """Columns that cells of rows above still cover: disjoint ranges in order, and when each cell ends."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.due: list[tuple[int, int, int]] = []  # (row it ends before, start, end)

    def begin(self, row: int) -> None:
        while self.due and self.due[0][0] <= row:
            _, s, e = heapq.heappop(self.due)
            i = bisect.bisect_right(self.starts, s) - 1
            a, z = self.starts[i], self.ends[i]
            self.starts[i : i + 1] = [x for x, y in ((a, s), (e, z)) if x < y]
            self.ends[i : i + 1] = [y for x, y in ((a, s), (e, z)) if x < y]

    def free(self, at: int) -> int:
        """The first column from `at` on that is free."""
        while (i := bisect.bisect_right(self.starts, at) - 1) >= 0 and self.ends[i] > at:
            at = self.ends[i]
        return at

    def cover(self, at: int, wide: int, until: int) -> None:
        """From the free column `at` on, up to the next covered one."""
        i = bisect.bisect_right(self.starts, at)
        end = min(at + wide, self.starts[i]) if i < len(self.starts) else at + wide
        heapq.heappush(self.due, (until, at, end))
        if i and self.ends[i - 1] == at:  # one range with the one before, and the one behind
            at = self.starts[i - 1]
            i -= 1
            del self.starts[i], self.ends[i]
        if i < len(self.starts) and self.starts[i] == end:
            end = self.ends[i]
            del self.starts[i], self.ends[i]
        self.starts.insert(i, at)
        self.ends.insert(i, end)


def table(n: Node, see: bool) -> list[str]:
    """Rows of cells on a grid (spans take up their places)."""
    out: list[str] = []
    rows: list[list[tuple[int, list[str], bool]]] = []
    grid, number = Grid(), 0

    def cells(kids: list, see: bool) -> None:
        nonlocal number
        grid.begin(number)
        at, line = 0, []
        for c in kids:
            if isinstance(c, str):
                if c.strip() and see:
                    out.append(_SPACE.sub(" ", c).strip())
                continue
            if hidden(c):
                continue
            at = grid.free(at)
            line.append((at, boxed(c, see=seen(c, see)), rightmost(c)))
            wide, tall = span(c, "colspan", 1000), span(c, "rowspan", 65534)
            if tall > 1:
                grid.cover(at, wide, number + tall)
            at += wide
        number += 1
        if any(x for _, x, _ in line):
            rows.append(line)

    def walk(node: Node, see: bool) -> None:
        loose: list = []
        for k in node.kids:
            if isinstance(k, str):
                if k.strip() and see:
                    out.append(_SPACE.sub(" ", k).strip())
            elif hidden(k):
                continue
            elif k.tag in ("thead", "tbody", "tfoot"):
                walk(k, seen(k, see))
            elif k.tag == "tr":
                cells(k.kids, seen(k, see))
            elif k.tag in ("td", "th"):
                loose.append(k)
            elif k.tag not in ("colgroup", "col"):
                out.extend(alone(k, see))
        if loose:
            cells(loose, see)

    walk(n, see)
    width: dict[int, int] = {}
    for line in rows:
        for at, text, _ in line:
            width[at] = max(width.get(at, 0), min(PAD, max(map(cells_wide, text), default=0)))
    begin, x = {}, 0
    for c in sorted(width):
        begin[c] = x
        x += width[c] + (2 if width[c] else 0)
    for line in rows:
        made: list[str] = []
        top = 0  # where cells begin: below lines that reach into the columns to their right
        for i, (at, text, right) in enumerate(line):
            if right:
                text = [" " * (width[at] - cells_wide(s)) + s if s else s for s in text]
            made += [""] * (top + len(text) - len(made))
            col = begin[at]
            for j, s in enumerate(text):
                if s:
                    have = made[top + j]
                    made[top + j] = (have + " " * (min(col, WIDE) - cells_wide(have)) if col <= WIDE or not have else have + "  ") + s
            if col < WIDE and i + 1 < len(line):
                reach = begin[line[i + 1][0]] - 2
                over = [j for j, s in enumerate(text) if s and col + cells_wide(s) > reach]
                if over and any(x for _, x, _ in line[i + 1 :]):
                    top += over[-1] + 1
        out += [x.rstrip() for x in made]
    return out


def to_text(page: str | None) -> str:
    if not page:
        return ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * MAX_DEPTH + 1000))  # a table in a cell is four calls
    out = Page()
    render(build(page.replace("\r\n", "\n").replace("\r", "\n")), out)
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract(df: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """id, text."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(x.as_py()) for x in b.column(1)], pa.string())], names=[id_col, "text"])

    return df.select(df[id_col], df[html].cast("string").alias("__html")).mapInArrow(run, f"`{id_col}` {kind}, text string")
