"""Visible text of HTML pages, laid out as a browser would.

A tree is built with implied end tags (p, li, dt, dd, table parts, option), then rendered as text:
scripts, styles, heads, templates and hidden elements are left out; blocks start on new lines and those with
margins are set apart by a blank line; list items get bullets or numbers and are indented; table
cells are padded so that columns align, with colspan (to 1000) and rowspan (to 65534) as in browsers; blanks collapse outside of pre.
Form fields show what they hold: the chosen option of a select (all options of a list box), the value of text inputs and buttons.
Formulas and the text of drawings are inline text, without titles, descriptions and definitions; an object shows its fallback.
Audio, video, canvas, iframe and noscript don't: browsers show something else in their place.

The output grows with the page, not with its square: columns align up to a width of ``COLUMN`` and a line position of ``LINE``,
a longer cell pushes what follows to the right in its own row only; blocks within more than ``LEVELS`` indented ones aren't
indented further.  Nesting has no limit: parser and renderer keep their own stacks.

Hidden is what has ``display: none`` or ``visibility: hidden`` in its style, or a tag, class or id for which style elements say ``display: none``
in the end: the last rule counts, ids before classes before tags, a style before all of them, important ones first; rules within media conditions
count on a screen ``SCREEN`` pixels wide.  So is what has the ``hidden`` attribute and no other display, the body of a closed ``details`` and
a ``dialog`` that isn't open.

Defined results: null and empty pages, and pages without visible text, give the empty text;
broken markup never fails; repeated rows are treated alike; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handing_back, text_slices

COLUMN, LINE, LEVELS = 60, 400, 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes audio video canvas datalist meta link".split())
#: What drawings and formulas don't show of their own.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask marker pattern annotation annotation-xml".split())
#: Inputs whose value isn't text on the page.
WORDLESS = frozenset("hidden password checkbox radio file color range image".split())
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre figure table hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option search section summary tr td th thead tbody tfoot caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt summary".split())
#: Tag that starts: tags that it ends, and tags beyond which it ends nothing.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "table", "td", "th"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "table", "td", "th"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
}
IMPLIED["tbody"] = IMPLIED["tfoot"] = IMPLIED["caption"] = IMPLIED["colgroup"] = IMPLIED["thead"]
BARRIER = frozenset(["table", "td", "th", "caption"])

TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
SIGNS = re.compile(r""""[^"]*"|'[^']*'|[{};]""")
SIMPLE = re.compile(r"[.#]?[\w-]+")
FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*([0-9.]+)\s*(px|em|rem)\s*\)")
#: The screen that style sheets are read for, in pixels, and pixels of an em.
SCREEN, EM = 1024, 16


def declared(style: str, name: str) -> tuple[bool, str] | None:
    """The value of a declaration and whether it is important: the last one, important ones first."""
    found = None
    for part in QUOTED.sub("''", style).split(";"):
        key, colon, value = part.partition(":")
        if colon and key.strip().lower() == name:
            value, mark, _ = value.lower().partition("!")
            if found is None or mark or not found[0]:
                found = (bool(mark), value.strip())
    return found


def for_screen(media: str) -> bool:
    """Whether a media query list holds on a screen of SCREEN pixels; conditions other than widths are taken not to hold."""
    for query in media.lower().split(","):
        words = query.strip().removeprefix("only ").strip()
        negated, words = words.startswith("not "), words.removeprefix("not ").strip()
        holds = True
        for part in re.split(r"\band\b", words):
            part = part.strip()
            if m := FEATURE.fullmatch(part):
                try:
                    width = float(m[2]) * (1 if m[3] == "px" else EM)
                except ValueError:
                    width = float("nan")
                holds &= SCREEN >= width if m[1] == "min" else SCREEN <= width
            else:
                holds &= part in ("", "all", "screen")
        if holds != negated:
            return True
    return False


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on the screen, those within at-rules included."""
    css = COMMENT.sub(" ", css)
    open_: list[tuple[str | None, int, bool]] = []  # selectors (None for an at-rule), begin of the body, whether it holds
    at = 0
    for m in SIGNS.finditer(css):
        if m[0][0] in "\"'":
            continue
        holds = open_[-1][2] if open_ else True
        if m[0] == "{":
            head = css[at : m.start()].strip()
            if head.startswith("@"):
                kind, _, condition = head[1:].partition(" ")
                kind = kind.partition("(")[0].lower()
                holds &= for_screen(condition or head[6:]) if kind == "media" else kind in ("supports", "layer", "container", "scope")
                open_.append((None, m.end(), holds))
            else:
                open_.append((head, m.end(), holds))
        elif m[0] == "}" and open_:
            selectors, begin, holds = open_.pop()
            if selectors is not None and holds:
                yield selectors, css[begin : m.start()]
        at = m.end()


class Open:
    """The open elements, and how many of each tag there are since the last table or cell began (and in all)."""

    def __init__(self, root: Node):
        self.stack, self.all, self.within = [root], Counter(), [Counter()]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.all[node.tag] += 1
        if node.tag in BARRIER:
            self.within.append(Counter())
        self.within[-1][node.tag] += 1

    def cut(self, i: int) -> list[Node]:
        """Close the elements from place i on."""
        gone = self.stack[i:]
        del self.stack[i:]
        for node in reversed(gone):
            self.all[node.tag] -= 1
            self.within[-1][node.tag] -= 1
            if node.tag in BARRIER:
                self.within.pop()
        return gone


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(html: str) -> tuple[Node, dict[str, tuple[bool, int, bool]]]:
    """The tree, and for each selector (tag, .class, #id) its last ``display`` in style elements: (important, place, whether it is none)."""
    root, hidden, places = Node("html", {}), {}, itertools.count()
    open_, at, n = Open(root), 0, len(html)
    stack = open_.stack
    no_end: set[str] = set()  # what is known not to occur any more: each is looked for in vain only once

    def find(what: str, start: int) -> int:
        if what in no_end:
            return -1
        if (found := html.find(what, start)) < 0:
            no_end.add(what)
        return found

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            text(html[at:])
            break
        c = html[lt + 1]
        if c.isalpha() and c.isascii():
            text(html[at:lt])
            name = NAME.match(html, lt + 1)
            tag = name[0].lower()
            if (m := TAG_END.match(html, name.end())) is not None:
                end = m.end()
            elif (gt := find(">", name.end())) >= 0:
                end = gt + 1
            else:
                break  # an unfinished tag at the end
            body = html[name.end() : end - 1]
            attributes = {a.lower(): unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(body)} if body.strip(" /") else {}
            at = end
            if tag in CLOSES_P and open_.within[-1]["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        open_.cut(i)
                        break
                    if stack[i].tag in BARRIER or stack[i].tag in ("li", "div", "button", "object"):
                        break
            if tag in IMPLIED and any(open_.all[x] for x in IMPLIED[tag][0]):
                ends, stop = IMPLIED[tag]
                cut = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in ends:
                        cut = i
                        if tag not in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup"):
                            break
                if cut is not None:
                    open_.cut(cut)
            if tag in ("html", "body") and len(stack) == 1:
                root.attributes |= attributes
                continue
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE)
                m = None if f"</{tag}" in no_end else close.search(html, at)
                if m is None:
                    no_end.add(f"</{tag}")
                    stop, after = n, n
                else:
                    stop, after = m.start(), html.find(">", m.end())
                    after = n if after < 0 else after + 1
                inner = html[at:stop]
                at = after
                if tag == "style" and for_screen(attributes.get("media") or ""):
                    for selectors, declarations in rules(inner):
                        if display := declared(declarations, "display"):
                            for name in filter(SIMPLE.fullmatch, map(str.strip, selectors.split(","))):
                                name = name if name[0] in ".#" else name.lower()
                                hidden[name] = max(hidden.get(name, (False, -1, False)), (display[0], next(places), display[1] == "none"))
                elif tag in ("textarea", "xmp"):
                    node.children.append(unescape(inner) if tag == "textarea" else inner)
            elif tag not in VOID and not (body.endswith("/") and tag in ("svg", "math", "path")):
                open_.push(node)
        elif c == "/":
            text(html[at:lt])
            gt = find(">", lt)
            if gt < 0:
                break
            name = NAME.match(html, lt + 2)
            at = gt + 1
            if name is None:
                continue
            tag = name[0].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            block, tabular = tag in BLOCK or tag in UNSEEN or tag in ("select", "svg", "math", "object"), tag in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption")
            if not (open_.all[tag] if tabular else open_.within[-1][tag]):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    gone = open_.cut(i)
                    if not block:  # an inline end tag doesn't end blocks that were opened since
                        for x in gone[1:]:
                            if x.tag in BLOCK:
                                open_.push(x)
                    break
                if stack[i].tag in BARRIER and not tabular:
                    break
        elif c in "!?":
            text(html[at:lt])
            if html.startswith("<!--", lt):
                stop = find("-->", lt + 2)
                at = n if stop < 0 else stop + 3
            else:
                stop = find(">", lt)
                at = n if stop < 0 else stop + 1
        else:
            text(html[at : lt + 1])
            at = lt + 1
    return root, hidden


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Finished lines, the line being written, the indentation, and the blank lines due before the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed blank waits for the next word
        self.due = 0
        self.rest, self.first = "", None  # what lines begin with, and the next line if that differs
        self.fresh = True  # no line yet in the innermost indented block
        self.levels: list[tuple[str, str | None, bool, int]] = []

    def push(self, first: str, rest: str) -> None:
        """Indent: the next line begins with ``first``, those after it with ``rest``."""
        self.end()
        self.levels.append((self.rest, self.first, self.fresh, self.due))
        deep = len(self.levels) > LEVELS
        self.first = (self.rest if self.first is None else self.first) + (first.strip() and first if deep else first)
        if not deep:
            self.rest += rest
        self.fresh = True

    def pop(self) -> bool:
        """End the indented block; whether it had a line."""
        self.end()
        had, (self.rest, first, fresh, due) = not self.fresh, self.levels.pop()
        self.first, self.fresh, self.due = (None, False, 0) if had else (first, fresh, due)
        return had

    def put(self, line: str) -> None:
        if self.due and self.done:
            self.done += [""] * self.due
        self.done.append(f"{self.rest if self.first is None else self.first}{line}".rstrip())
        self.due, self.first, self.fresh = 0, None, False

    def flow(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if text[:1] == " ":
            self.space, text = True, text[1:]
        if not text:
            return
        ends = text[-1] == " "
        if self.space and self.now:
            self.now.append(" ")
        self.space = ends
        if text := text[:-1] if ends else text:
            self.now.append(text)

    def end(self) -> None:
        self.space = False
        if self.now:
            self.put("".join(self.now))
            self.now = []

    def gap(self, blank: int = 0) -> None:
        self.end()
        if not self.fresh:
            self.due = max(self.due, blank)

    def finished(self) -> list[str]:
        self.end()
        return self.done


def number(i: int, kind: str) -> str:
    if kind in ("a", "A") and i > 0:
        out = ""
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(ord(kind) + r) + out
        return out
    if kind in ("i", "I") and 0 < i < 4000:
        out = ""
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            while i >= value:
                out, i = out + letters, i - value
        return out if kind == "i" else out.upper()
    return str(i)


def whole(text: str | None, otherwise: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,6})", text or "")
    return int(m[1]) if m else otherwise


def run(step: Iterator) -> None:
    """Run a generator that yields the generators it waits for, on a stack of our own: nesting is limited by memory only."""
    steps = [step]
    while steps:
        inner = next(steps[-1], None)
        if inner is None:
            steps.pop()
        else:
            steps.append(inner)


class Renderer:
    """Methods that meet nested elements are generators for run()."""

    def __init__(self, hidden: dict[str, tuple[bool, int, bool]]):
        self.hidden = hidden

    def seen(self, node: Node) -> bool:
        a = node.attributes
        if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in a):
            return False
        found = []  # (important, how special the selector is, place, none)
        if self.hidden:
            names = [(0, node.tag), (2, f"#{a.get('id')}"), *((1, f".{c}") for c in a.get("class", "").split())]
            found = [(rule[0], special, *rule[1:]) for special, name in names if (rule := self.hidden.get(name))]
        if "style" in a and (display := declared(a["style"], "display")):
            found.append((display[0], 3, 0, display[1] == "none"))
        return not max(found)[3] if found else "hidden" not in a

    def children(self, node: Node, out: Lines, pre: bool, shown: bool) -> Iterator:
        for child in node.children:
            if isinstance(child, str):
                self.text(child, out, pre, shown)
            else:
                yield self.one(child, out, pre, shown)

    def text(self, text: str, out: Lines, pre: bool, shown: bool) -> None:
        if not shown:
            return
        if not pre:
            out.flow(text)
            return
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line_break(out)
            if line:
                out.now.append(line)

    def line_break(self, out: Lines) -> None:
        if out.now:
            out.end()
        else:
            out.put("")

    def one(self, node: Node, out: Lines, pre: bool, shown: bool) -> Iterator:
        if not self.seen(node):
            return
        tag = node.tag
        if style := node.attributes.get("style"):
            visibility = declared(style, "visibility")
            if visibility and visibility[1] in ("hidden", "collapse", "visible"):
                shown = visibility[1] == "visible"
        if tag == "br":
            self.line_break(out)
        elif tag == "hr":
            out.gap(1)
            out.put("---")
            out.gap(1)
        elif tag == "input":
            a = node.attributes
            if shown and a.get("type", "text").lower() not in WORDLESS:
                out.flow(f" {a.get('value') or a.get('placeholder', '')} ")
        elif tag in VOID:
            return
        elif tag == "select":
            yield self.options(node, out, shown)
        elif tag == "svg" or tag == "math":
            self.drawing(node, out, shown)
        elif tag in ("ul", "ol", "menu", "dir"):
            yield self.listing(node, out, pre, shown)
        elif tag == "table":
            yield self.table(node, out, pre, shown)
        elif tag == "blockquote" or tag == "dd":
            blank = int(tag == "blockquote")
            out.gap(blank)
            out.push("    ", "    ")
            yield self.children(node, out, pre, shown)
            out.pop()
            out.gap(blank)
        elif tag == "details" and "open" not in node.attributes:
            out.gap()
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    yield self.one(child, out, pre, shown)
                    break
            out.gap()
        elif tag == "pre":
            out.gap(1)
            out.push("", "")
            first = node.children[0] if node.children else None
            if isinstance(first, str) and (cut := re.match("\r?\n", first)):  # a line end right behind the tag doesn't count
                self.text(first[cut.end() :], out, True, shown)
                node.children = node.children[1:]
            yield self.children(node, out, True, shown)
            out.pop()
            out.gap(1)
        elif tag in BLOCK:
            blank = int(tag in SPACED)
            out.gap(blank)
            yield self.children(node, out, pre, shown)
            out.gap(blank)
        else:
            yield self.children(node, out, pre, shown)

    def options(self, node: Node, out: Lines, shown: bool) -> Iterator:
        """A closed select shows the option chosen last, or its first; a list box shows all."""
        a, found, groups = node.attributes, [], [node]
        for group in groups:  # select and its optgroups
            for child in group.children:
                if isinstance(child, Node) and self.seen(child):
                    if child.tag == "option":
                        found.append(child)
                    else:
                        groups.append(child)
        if "multiple" not in a and whole(a.get("size"), 1) <= 1:
            found = [x for x in found if "selected" in x.attributes][-1:] or found[:1]
        for x in found:
            out.flow(" ")
            yield self.children(x, out, False, shown)
            out.flow(" ")

    def drawing(self, node: Node, out: Lines, shown: bool) -> None:
        """The text elements of a drawing, or all of a formula, in order."""
        todo, formula = [node], node.tag == "math"
        inside = []  # parallel to todo: whether text counts there
        inside.append(formula)
        while todo:
            x, counts = todo.pop(), inside.pop()
            if isinstance(x, str):
                if counts and shown:
                    out.flow(x)
                continue
            if x is not node and (x.tag in UNDRAWN or not self.seen(x)):
                continue
            counts = counts or x.tag in ("text", "foreignobject")
            if x.tag in ("text", "foreignobject"):
                out.flow(" ")
            todo += reversed(x.children)
            inside += [counts] * len(x.children)

    def listing(self, node: Node, out: Lines, pre: bool, shown: bool) -> Iterator:
        a, ordered = node.attributes, node.tag == "ol"
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and self.seen(c)]
        back = ordered and "reversed" in a
        at = whole(a.get("start"), len(items) if back else 1)
        blank = int(not (out.now or (out.levels and not out.fresh)))  # a list within an item follows its text
        out.gap(blank)
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    self.text(child, out, pre, shown)
                    out.gap()
                continue
            if child.tag != "li":
                yield self.one(child, out, pre, shown)
                out.gap()
                continue
            if not self.seen(child):
                continue
            at = whole(child.attributes.get("value"), at)
            mark = f"{number(at, a.get('type', '1'))}. " if ordered else "- "
            at += -1 if back else 1
            out.gap()
            out.push(mark, " " * len(mark))
            yield self.children(child, out, pre, shown)
            out.pop()
        out.gap(blank)

    def rows(self, node: Node) -> tuple[list[Node], list[Node | str]]:
        """The rows, and what stands above or by mistake between them."""
        found, above, todo, loose = [], [], [*reversed(node.children)], None
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                if child.strip():
                    above.append(child)
            elif not self.seen(child):
                continue
            elif child.tag == "tr":
                found.append(child)
                above += [x for x in child.children if (x.strip() if isinstance(x, str) else x.tag not in ("td", "th"))]
                loose = None
            elif child.tag in ("thead", "tbody", "tfoot"):
                todo += reversed(child.children)
                loose = None
            elif child.tag in ("td", "th"):
                if loose is None:
                    loose = Node("tr", {})
                    found.append(loose)
                loose.children.append(child)
            elif child.tag not in ("col", "colgroup"):
                above.append(child)
        return found, above

    def table(self, node: Node, out: Lines, pre: bool, shown: bool) -> Iterator:
        rows, above = self.rows(node)
        out.gap(1)
        out.push("", "")
        for x in above:
            if isinstance(x, str):
                self.text(x, out, pre, shown)
            else:
                yield self.one(x, out, pre, shown)
        out.end()
        grid, held = [], []  # (first column, end, rows until): what cells from above still cover
        for r, row in enumerate(rows):
            held = sorted(h for h in held if h[2] > r)
            line, column, k = [], 0, 0
            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not self.seen(cell):
                    continue
                while k < len(held) and held[k][0] <= column:
                    column, k = max(column, held[k][1]), k + 1
                span = max(1, min(1000, whole(cell.attributes.get("colspan"), 1)))
                down = max(1, min(65_534, whole(cell.attributes.get("rowspan"), 1)))
                inner = Lines()
                yield self.children(cell, inner, pre, shown)
                line.append((column, span, inner.finished() or [""]))
                if down > 1:
                    held.append((column, column + span, r + down))
                    held[k:] = sorted(held[k:])
                    k += held[k] == (column, column + span, r + down)
                column += span
            grid.append(line)
        for line in aligned([line for line in grid if any(any(x) for _, _, x in line)]):
            out.put(line)
        out.pop()
        out.gap(1)


def aligned(grid: list[list[tuple[int, int, list[str]]]]) -> Iterator[str]:
    """Lines of a table of (column, span, lines) cells: columns are as wide as their widest cell of one column, up to COLUMN;
    spanning cells widen their last column; a cell begins at its column, or two blanks behind the text before it."""
    wide: dict[int, int] = {}
    for span, column, w in sorted((span, column, max(map(width, x))) for line in grid for column, span, x in line):
        last = column + span - 1
        room = sum(wide[k] + 2 for k in (range(column, last) if span <= len(wide) else wide) if column <= k < last and wide.get(k))
        wide[last] = max(wide.get(last, 0), min(w - room, COLUMN))
    columns = sorted(k for k, w in wide.items() if w > 0)
    starts = [0, *itertools.accumulate(wide[k] + 2 for k in columns)]
    for line in grid:
        active, i = [(min(LINE, starts[bisect_left(columns, column)]), x) for column, _, x in line], 0
        while active:
            text, used = [], 0
            for start, x in active:
                if x[i]:
                    begin = max(start, used + 2 if text else 0)
                    text.append(" " * (begin - used) + x[i])
                    used = begin + width(x[i])
            yield "".join(text)
            i += 1
            active = [c for c in active if len(c[1]) > i]


def extract(html: str | None) -> str:
    if not html:
        return ""
    root, hidden = parse(html)
    out = Lines()
    run(Renderer(hidden).one(root, out, False, True))
    return "\n".join(out.finished()).strip("\n")


def visible_text(pages: DataFrame, html: str = "html", keep: list[str | Column] = ("page_id",), out: str = "text") -> DataFrame:
    """The ``keep`` columns of every page with its visible text."""

    @F.arrow_udf("string")
    @handing_back
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array(list(map(extract, some)), pa.string()) for some in text_slices(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return pages.select(*keep, texts(F.col(html).cast("string")).alias(out))
