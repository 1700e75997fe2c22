"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, then block layout.

The tree builder takes any bytes of markup: it opens and closes what the grammar implies (paragraphs, list items, table
rows and cells), keeps raw text of scripts and styles apart, and repairs stray and missing end tags. Hidden are what the
browser hides by default, ``hidden`` attributes, hidden inputs, closed details, and elements that inline styles or simple
rules of the page's style sheets (a tag, class or id) turn off; a visible child of an element of hidden visibility shows.
Rules inside at-rules count only where these plainly hold for a screen. Formulas and the text elements of drawings show.

Layout: white space collapses outside ``pre``; blocks begin on new lines, and paragraphs, headings, lists and tables stand
between blank lines; list items have bullets or numbers and are indented by depth; table cells are padded to their
column's width, up to ``WIDEST``, with spans counted. Tables nested deeper than ``DEEPEST`` are laid out as blocks.

Null and empty pages give an empty text. Rows are independent, so repeated rows give equal results, and an empty table gives
an empty one; other columns, whatever their names, are neither read nor returned. Long pages are rendered whole, without
recursion but for nested tables. ``WIDEST``, ``DEEPEST`` and at most 100 columns a cell bound the blanks and the depth of a
layout, not its words: whatever is beyond them is still shown. So does ``PADDING``, the most blanks put before one cell, as
else a page of a few hundred kilobytes whose cells each span all rows below would take gigabytes of blanks.
"""

from __future__ import annotations

import hashlib
import heapq
import html
import re
from bisect import bisect_right, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, table, texts_of

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[a-zA-Z][^>]*(?:>|\Z)|<[a-zA-Z](?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
#: At-rules whose rules hold on a screen, whatever its size.
PLAIN = re.compile(r"@layer\b.*|@media\s*(?:.*,)?\s*(?:|(?:only\s+)?(?:all|screen)|not\s+(?:print|speech))\s*(?:,.*)?", re.S | re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section "
    "select summary table tbody td tfoot th thead tr caption ul xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu dir ol p pre table ul xmp listing fieldset".split())
UNSEEN = frozenset("area base datalist embed head iframe link meta noembed noframes object param rp script source style template title track audio video canvas".split())
#: What a drawing or a formula doesn't show, and the elements of HTML that end one that is left open.
FOREIGN_UNSEEN = {"svg": frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split()), "math": frozenset("annotation annotation-xml".split())}
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Start tag: open elements that it closes, and those that stop the search for them.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"), "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"), "caption": ("caption", "table"), "colgroup": ("colgroup caption", "table"),
    "rt": ("rt rp", "ruby"), "rp": ("rt rp", "ruby"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
CLOSE_P = BLOCKS - frozenset("body html li dd dt option optgroup select td th tr tbody thead tfoot caption legend summary".split())
SCOPE = frozenset("td th caption table html template button".split())
WIDEST, DEEPEST, PADDING = 60, 20, 1000


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(markup: str) -> tuple[Node, list[str]]:
    """(tree, style sheets)."""
    root = Node("html")
    stack, sheets = [root], []
    modes = ["html"]  # of the elements on the stack: html, svg, text (of a drawing) or math
    places: dict[str, list[int]] = defaultdict(list)  # on the stack, of the elements of each tag, so that no search walks it

    def pop_to(at: int) -> None:
        for node in reversed(stack[at:]):
            places[node.tag].pop()
        del stack[at:], modes[at:]

    def last(tags: frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: frozenset, stops: frozenset) -> None:
        first = last(tags)
        if first > last(stops):
            while first > 1 and stack[first - 1].tag in tags:
                first -= 1
            pop_to(first)

    def put(node: Node, is_open: bool) -> None:
        mode = modes[-1]
        if mode == "html":
            mode = node.tag if node.tag in FOREIGN_UNSEEN else mode
        elif node.tag in FOREIGN_UNSEEN["math" if mode == "math" else "svg"]:
            node.attrs["hidden"] = ""
        elif mode == "svg" and node.tag == "text":
            mode = "text"
            stack[-1].children.append(" ")  # texts of a drawing stand apart
        elif node.tag == "foreignobject" or mode == "math" and node.tag in ("mi", "mo", "mn", "ms", "mtext"):
            mode = "html"
        stack[-1].children.append(node)
        if is_open:
            stack.append(node)
            modes.append(mode)
            places[node.tag].append(len(stack) - 1)

    def add_text(text: str) -> None:
        if text and modes[-1] != "svg":
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    at, n = 0, len(markup)
    lower = None
    while at < n:
        m = TOKEN.search(markup, at)
        if not m:
            add_text(markup[at:])
            break
        add_text(markup[at : m.start()])
        at, token = m.end(), m.group()
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                if modes[-1] != "svg":
                    stack[-1].children.append(token[9:].removesuffix("]]>"))
            continue
        named = NAME.match(token)
        tag = named[1].lower()
        if token[1] == "/":
            if tag == "br":
                put(Node("br"), False)
            elif tag not in ("body", "html"):
                at_last = last(frozenset((tag,)))
                if at_last > (0 if tag == "table" else last(SCOPE - {tag})):
                    pop_to(at_last)
                elif tag == "p":
                    put(Node("p"), False)
            continue
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(token[named.end() :].rstrip(">"))} if len(token) > named.end() + 1 else {}
        if tag in ("html", "body", "head"):
            if tag == "body":
                if places["head"]:
                    pop_to(places["head"][0])
            if tag == "head" and len(stack) == 1:
                put(Node("head", attrs), True)
            else:
                stack[-1].attrs.update({k: v for k, v in attrs.items() if len(stack) == 1})
            continue
        if len(stack) > 1 and stack[1].tag == "head" and tag not in HEAD:
            pop_to(1)
        if modes[-1] != "html" and tag in BREAKOUT:
            inside = len(stack)
            while modes[inside - 1] != "html":
                inside -= 1
            pop_to(inside)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in CLOSE_P:
            close(frozenset(("p",)), SCOPE)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            put(Node("tr"), True)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            pop_to(len(stack) - 1)
        node = Node(tag, attrs)
        put(node, tag not in VOID and not token.endswith("/>") or tag in BLOCKS and tag != "hr")
        if tag in RAW:
            if lower is None:
                lower = markup.lower()
                lower = lower if len(lower) == n else markup  # some letters change length
            end = lower.find(f"</{tag}", at)
            end = n if end < 0 else end
            body = markup[at:end]
            if tag == "style":
                sheets.append(body)
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            if stack[-1] is node:
                pop_to(len(stack) - 1)
            after = markup.find(">", end)
            at = n if after < 0 else after + 1
    return root, sheets


#: What the two properties that hide text are in a list of declarations: property → (is it important, value). A value is
#: whether the element isn't displayed, and whether it is visible, None as its parent is.
Declared = dict[str, tuple[bool, bool | None]]
VISIBILITY = {"hidden": False, "collapse": False, "visible": True, "initial": True, "inherit": None, "unset": None, "revert": None}


def declared(style: str) -> Declared:
    out: Declared = {}
    for part in style.split(";"):
        key, _, value = part.partition(":")
        key, value = key.strip().lower(), value.strip().lower()
        plain = re.sub(r"\s*!\s*important$", "", value)
        if key == "display" and plain or key == "visibility" and plain in VISIBILITY:
            important = plain != value
            if important or not out.get(key, (False,))[0]:
                out[key] = (important, plain == "none" if key == "display" else VISIBILITY[plain])
    return out


def screen_rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, own declarations) of the rules that plainly hold on a screen, in order."""
    out, opened, text, at = [], [], [], 0  # opened: (prelude, does it hold, declarations)
    for m in CSS.finditer(sheet):
        text.append(sheet[at : m.start()])
        at, sign = m.end(), m.group()
        if sign[0] in "\"'":
            text.append(sign)
        elif sign == "{":
            prelude = "".join(text).strip()
            holds = all(is_plain for _, is_plain, _ in opened[-1:])
            # what stands in a rule is not its own, and hangs on the rule's selector
            opened.append((prelude, holds and bool(PLAIN.fullmatch(prelude)), []))
            if holds and not prelude.startswith("@"):
                opened[-1] = (prelude, False, opened[-1][2])
                out.append((prelude, opened[-1][2]))
            text = []
        elif sign == ";":
            if opened:
                opened[-1][2].append("".join(text))
            text = []
        elif sign == "}":
            if opened:
                opened.pop()[2].append("".join(text))
            text = []
    if opened:
        opened[-1][2].append("".join(text) + sheet[at:])
    return [(prelude, ";".join(body)) for prelude, body in out]


#: Selector → property → (is it important, place among all rules, value) of the declaration that wins for it.
Rules = dict[str, dict[str, tuple[bool, int, bool | None]]]


def sheet_rules(sheets: list[str]) -> Rules:
    """Simple selectors (a tag, .class or #id) that hide or show; each property is kept apart."""
    out: Rules = {}
    place = 0
    for sheet in sheets:
        for selectors, body in screen_rules(sheet):
            found = declared(body) if "display" in body.lower() or "visibility" in body.lower() else {}
            if not found:
                continue
            place += 1
            for selector in selectors.split(","):
                selector = selector.strip()
                if re.fullmatch(r"[.#]?[\w-]+", selector):
                    own = out.setdefault(selector if selector[0] in ".#" else selector.lower(), {})
                    for key, (important, value) in found.items():
                        if important or not own.get(key, (False,))[0]:
                            own[key] = (important, place, value)
    return out


class Layout:
    """Gathers text into lines, with pending white space, line breaks and blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.mark = ""

    def text(self, value: str, keep: bool) -> None:
        if keep:
            parts = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.end(True)
                if part:
                    self.begin()
                    self.now.append(part)
            return
        words = value.split()
        if not words:
            self.space |= bool(value)
            return
        if (self.space or value[0].isspace()) and self.now:
            self.now.append(" ")
        self.begin()
        self.now.append(" ".join(words))
        self.space = value[-1].isspace()

    def begin(self) -> None:
        if not self.now:
            if self.blank and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.blank = False
            self.now.append(self.indent + self.mark)
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""

    def end(self, always: bool = False) -> None:
        """Ends the line; without text on it only where a break is forced."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif always and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.space = False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self.begin()
            self.now.append(line)
            self.end()

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def visibility(node: Node, rules: Rules, seen: bool) -> tuple[bool, bool]:
    """(is displayed, is visible) of an element. Of all declarations of a property, important ones win, then those of the
    style attribute, of an id, of classes, of the tag, then the last."""
    if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
        return False, seen
    best: dict[str, tuple] = {}
    keys = [(0, node.tag), *((1, "." + c) for c in node.attrs.get("class", "").split()), (2, "#" + node.attrs.get("id", ""))] if rules else []
    found = [(key, (important, weight, place), value) for weight, name in keys for key, (important, place, value) in rules.get(name, {}).items()]
    found += [(key, (important, 3, 0), value) for key, (important, value) in declared(node.attrs["style"]).items()] if "style" in node.attrs else []
    for key, rank, value in found:
        if key not in best or rank >= best[key][0]:
            best[key] = (rank, value)
    shown = best["visibility"][1] if "visibility" in best else None
    return not ("display" in best and best["display"][1]), seen if shown is None else shown


def number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else default


def render(root: Node, rules: dict, depth: int = 0, seen: bool = True, keep: bool = False) -> list[str]:
    """Lines of the visible text of ``root``'s children."""
    out = Layout()
    lists: list[list] = []  # [is ordered, next number, step]
    work: list[tuple] = [("node", c, seen, keep) for c in reversed(root.children)]
    while work:
        kind, item, seen, keep = work.pop()
        if kind == "close":
            tag, indent, opened = item
            if opened:
                lists.pop()
            if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists):
                out.gap()
            elif tag in BLOCKS:
                out.end()
            if tag in BLOCKS:
                out.indent, out.mark = indent, ""
            elif tag == "q":
                out.text("”", True)
            continue
        if isinstance(item, str):
            if seen:
                out.text(item, keep)
            continue
        shown, seen = visibility(item, rules, seen)
        if not shown:
            continue
        tag = item.tag
        if tag == "br":
            out.begin() if out.lines and not out.now else None
            out.end(True)
            continue
        if tag == "hr":
            out.gap()
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "input":
            kind = item.attrs.get("type", "text").lower()
            if seen and kind not in ("password", "checkbox", "radio", "file", "image", "range", "color"):
                out.text(f" {item.attrs.get('value') or item.attrs.get('placeholder', '')} ", False)
            continue
        if tag == "table" and depth < DEEPEST:
            out.gap()
            out.rows(table_lines(item, rules, depth + 1, seen, keep))
            out.gap()
            continue
        children = item.children
        if tag == "details" and "open" not in item.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options = [c for c in children if isinstance(c, Node) and c.tag in ("option", "optgroup")]
            options = [o for c in options for o in ([x for x in c.children if isinstance(x, Node)] if c.tag == "optgroup" else [c])]
            children = ([o for o in options if "selected" in o.attrs] or options)[: None if "multiple" in item.attrs else 1]
        indent, opened = out.indent, False
        if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists):
            out.gap()
        elif tag in BLOCKS:
            out.end()
        if tag in ("ul", "ol", "menu", "dir"):
            items = sum(isinstance(c, Node) and c.tag == "li" for c in children) if "reversed" in item.attrs else 0
            lists.append([tag == "ol", number(item.attrs.get("start"), items or 1), -1 if items else 1])
            opened = True
        elif tag == "li":
            if lists:
                own = lists[-1]
                own[1] = number(item.attrs.get("value"), own[1])
                out.mark = f"{own[1]}. " if own[0] else "- "
                own[1] += own[2]
            else:
                out.mark = "- "
        elif tag in ("dd", "blockquote"):
            out.indent += "  "
        elif tag == "q":
            out.text("“", True)
        keep = keep or tag in ("pre", "textarea", "listing", "xmp")
        work.append(("close", (tag, indent, opened), seen, keep))
        if tag in ("td", "th") and out.now:
            out.space = True
        work += [("node", c, seen, keep) for c in reversed(children)]
    return out.done()


class Columns:
    """The columns that no cell from a row above still takes, as sorted gaps; the work grows with the cells, not their spans."""

    def __init__(self) -> None:
        self.gaps: list[tuple[int, int]] = [(0, 1 << 60)]
        self.row = 0
        self.taken: list[tuple[int, int, int]] = []  # heap: row from which it is free, start, end

    def first(self, column: int) -> int:
        """The first open column from this one on."""
        i = bisect_right(self.gaps, (column, 1 << 61)) - 1
        if i >= 0 and column < self.gaps[i][1]:
            return column
        return self.gaps[i + 1][0]

    def take(self, start: int, end: int, down: int) -> None:
        """Takes what is open of these columns for ``down`` rows, this one included."""
        i = max(bisect_right(self.gaps, (start, 1 << 61)) - 1, 0)
        j = i
        left: list[tuple[int, int]] = []
        while self.gaps[j][0] < end:
            low, high = self.gaps[j]
            a, b = max(low, start), min(high, end)
            if a < b:
                heapq.heappush(self.taken, (self.row + down, a, b))
            left += [piece for piece in ((low, min(high, start)), (max(low, end), high)) if piece[0] < piece[1]]
            j += 1
            if high >= end:
                break
        self.gaps[i:j] = left

    def next_row(self) -> None:
        self.row += 1
        while self.taken and self.taken[0][0] <= self.row:
            _, start, end = heapq.heappop(self.taken)
            insort(self.gaps, (start, end))


def table_lines(node: Node, rules: dict, depth: int, seen: bool, keep: bool) -> list[str]:
    """Lines of a table: its caption, then rows of cells padded to their columns."""
    rows: list[list[tuple[int, list[str]]]] = []
    caption: list[str] = []
    widths: dict[int, int] = {}
    open_columns = Columns()
    work = [(c, seen) for c in reversed(node.children)]
    stray = Node("div")
    while work:
        item, seen_here = work.pop()
        if isinstance(item, str) or item.tag not in ("tbody", "thead", "tfoot", "tr", "caption", "colgroup", "col"):
            stray.children.append(item)  # what a table can't hold stands before it
            continue
        shown, seen_here = visibility(item, rules, seen_here)
        if not shown or item.tag in ("colgroup", "col"):
            continue
        if item.tag == "caption":
            caption += render(item, rules, depth, seen_here, keep)
            continue
        if item.tag != "tr":
            work += [(c, seen_here) for c in reversed(item.children)]
            continue
        row, column = [], 0
        for cell in item.children:
            if isinstance(cell, str):
                if cell.strip():
                    stray.children.append(cell)
                continue
            shown, cell_seen = visibility(cell, rules, seen_here)
            if not shown:
                continue
            column = open_columns.first(column)
            lines = render(cell, rules, depth, cell_seen, keep) if cell.tag in ("td", "th") else render(_only(cell), rules, depth, cell_seen, keep)
            span = min(max(number(cell.attrs.get("colspan"), 1), 1), 100)
            down = min(max(number(cell.attrs.get("rowspan"), 1), 1), 65534)  # as the grammar allows
            row.append((column, lines))
            if span == 1:
                widths[column] = max(widths.get(column, 0), min(max(map(len, lines), default=0), WIDEST))
            widths.setdefault(column, 0)
            if down > 1:
                open_columns.take(column, column + span, down)
            column += span
        open_columns.next_row()
        rows.append(row)
    starts, at = {}, 0
    for c in sorted(widths):
        starts[c] = at
        at += widths[c] + (2 if widths[c] else 0)
    out = [*render(stray, rules, depth, seen, keep), *caption]
    for row in rows:
        for i in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for column, lines in row:
                if i < len(lines) and lines[i]:
                    gap = starts[column] - len(line)
                    line += " " * min(gap, PADDING) if gap >= 0 else "  "
                    line += lines[i]
            out.append(line.rstrip())
    return out


def _only(node: Node) -> Node:
    parent = Node("div")
    parent.children.append(node)
    return parent


def visible_text(markup: str) -> str:
    root, sheets = parse(markup)
    return "\n".join(render(root, sheet_rules(sheets)))


RESULT = "text string, n_chars long, n_lines long, text_sha256 string"


def extract_text(df: DataFrame, markup: str = "html", id_column: str = "page_id") -> DataFrame:
    """A row for each row of ``df``: its id, the visible text, its characters and lines, and its hash. Narrow: no shuffle."""
    kind = df.schema[id_column].dataType.simpleString()

    def part(batch: pa.RecordBatch) -> dict:
        texts = [visible_text(t) for t in texts_of(batch, "__t")]
        return {
            id_column: batch.column("__i"), "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts],
            "text_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
        }

    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{markup}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, {RESULT}", part, "__t")


def op5_html_text(spark, sf_dir) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
