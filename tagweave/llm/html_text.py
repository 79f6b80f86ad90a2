"""Visible text of HTML pages, laid out as it would be read.

A tokenizer and a builder of open elements (with the usual implied end tags)
drive a renderer: hidden elements say nothing, blocks are kept apart by line
breaks or blank lines, list items get bullets or numbers with indentation, and
table cells are aligned in columns, as their spans over columns and rows say. All
visible text is kept, navigation and footers included. What a closed ``details``
holds beside its summary isn't visible; ``visibility`` is inherited, and an
element within a hidden one can be visible again.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import small_batches

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
# Classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object audio video canvas svg math select datalist textarea noembed noframes".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav section summary tr caption".split()
)
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
SCOPE = frozenset("table td th caption html template button object".split())
#: start tag -> open elements that it ends
CLOSES = {
    **dict.fromkeys(BLOCK - {"li", "dd", "dt", "tr", "caption", "html", "body", "summary", "legend"}, ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "td": ("td", "th", "p", "caption"), "th": ("td", "th", "p", "caption"), "tr": ("td", "th", "tr", "p", "caption"),
    "thead": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"),
    "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), "caption": ("caption",), "body": ("head",),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), ("p", "h1", "h2", "h3", "h4", "h5", "h6")),
}
#: where the search for an element to end stops
_BARRIER = {
    "li": frozenset(("ul", "ol", "menu", "dir")) | SCOPE, "dt": frozenset(("dl",)) | SCOPE, "dd": frozenset(("dl",)) | SCOPE,
    **dict.fromkeys(("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), frozenset(("table", "html", "template"))),
}
_HEAD_ONLY = frozenset("html head title meta link base style script noscript template".split())


#: Blanks that are shown before a line at most, however deep its list.
INDENT = 60


class _Lines:
    """Text with pending line breaks; blanks are collapsed unless text is preformatted."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.blank, self.empty, self.indent, self.mark = 0, False, True, 0, ""

    def line_break(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.blank = False

    def forced_break(self) -> None:
        self.breaks += 1
        self.blank = False

    def add(self, text: str, keep: bool = False) -> None:
        if keep:
            lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, line in enumerate(lines):
                if k:
                    self.forced_break()
                if line:
                    self._put(line)
            return
        if text[:1] in " \t\n\r\f":
            self.blank = True
        body = _BLANKS.sub(" ", text).strip(" ")
        if body:
            self._put(body)
            self.blank = text[-1] in " \t\n\r\f"

    def _put(self, text: str) -> None:
        if self.empty or self.breaks:
            if not self.empty:
                self.parts.append("\n" * self.breaks)
            lead = " " * min(self.indent, INDENT)
            if self.mark:
                lead = lead[: max(0, len(lead) - len(self.mark))] + self.mark
                self.mark = ""
            self.parts.append(lead)
        elif self.blank:
            self.parts.append(" ")
        self.parts.append(text)
        self.breaks, self.blank, self.empty = 0, False, False

    def text(self) -> str:
        return "".join(self.parts)


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


#: Characters of the widest cell that a column makes room for, place in a line up to which columns are aligned,
#: columns that one cell may span and that cells may hold in the rows below, and how deep tables are laid out as such.
COLUMN, LINE, SPAN, TABLE_DEPTH = 80, 400, 1000, 20


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, str]]]:
    """(column, text) of the cells of each row; cells that span rows keep their columns in the rows below."""
    out, upto, last = [], np.zeros(SPAN + 1, np.int64), 0  # upto: the row at which each column is free again
    for r, row in enumerate(rows):
        column, line, held = 0, [], []
        for text, across, down in row:
            if r < last and column < SPAN:
                column += int(np.argmax(upto[column:] <= r))  # beyond the last column all are free
            line.append((column, text))
            if down > 1:
                held.append((column, column + across, r + down))
            column += across
        out.append(line)
        for a, z, end in held:
            upto[a : min(z, SPAN)] = end
            last = max(last, end)
    return out


def _table(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of (text, columns, rows it spans): columns aligned, two blanks apart.

    Each cell begins at its column, on the line where the cell before it ended,
    so words stay in the page's order when cells have several lines. A column
    is as wide as the widest line in it of at most ``COLUMN`` characters; a
    longer one pushes what follows in its row. Columns that would begin beyond
    ``LINE`` are two blanks apart, so padding is bounded for each row.
    """
    grid = [[(k, text.split("\n")) for k, text in line] for line in _placed(rows)]
    wide: dict[int, int] = {}
    for line in grid:
        for k, lines in line:
            wide[k] = max([wide.get(k, 0), *(n for n in map(_width, lines) if n <= COLUMN)])
    at, begin = 0, {}
    for k in sorted(wide):
        begin[k] = at
        at = min(at + wide[k] + 2, LINE)
    out = []
    for line in grid:
        parts, end = [], 0
        for k, lines in line:
            if lines == [""]:
                continue
            if parts and lines[0]:
                gap = max(2, begin[k] - end) if end else begin[k]
            else:
                gap = begin[k]
            for i, one in enumerate(lines):
                if i:
                    parts.append("\n")
                    end, gap = 0, begin[k]
                if one:
                    parts += [" " * gap, one]
                    end += gap + _width(one)
        text = "".join(parts)
        if text.strip():
            out.append(text)
    return "\n".join(out)


class Renderer:
    def __init__(self):
        # element, what it adds to the hidden ones while it is open, whether that is a closed details, and whether text was invisible before
        self.open: list[tuple[str, int, bool, bool]] = []
        self.at: dict[str, list[int]] = {}  # where each element is open
        self.blocks: list[int] = []  # where blocks other than paragraphs are open
        self.hidden, self.pre, self.invisible, self.flat = 0, 0, False, 0
        self.page = _Lines()
        self.lines = [self.page]
        self.lists: list[list] = []  # [kind, number, indent]
        self.tables: list[dict] = []

    # ---- builder ----
    def start(self, tag: str, attrs: str) -> None:
        ends = CLOSES.get(tag)
        if ends:
            self._end_implied(tag, ends)
        if self.open and self.open[-1][0] == "head" and tag not in _HEAD_ONLY:
            self.close_to(len(self.open) - 1)
        hides = int(tag in HIDDEN or (bool(attrs) and _hides(tag, attrs)))
        if tag in VOID:
            if not self.hidden and not hides:
                self._void(tag)
            return
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK and tag != "p":
            self.blocks.append(len(self.open))
        if tag == "summary" and self.open and self.open[-1][2]:
            hides -= 1  # what its details hides is not the summary
        closed = tag == "details" and not hides and not re.search(r"(?i)(?<![\w-])open(?![\w-])", attrs or "")
        self.open.append((tag, hides + closed, closed, self.invisible))
        if attrs and "visibility" in attrs.lower():
            self.invisible = _invisible(attrs, self.invisible)
        self.hidden += hides
        if not self.hidden:
            self._enter(tag, attrs)
        self.hidden += closed

    def _last(self, tags) -> int:
        """Where the innermost open one of ``tags`` is; -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _end_implied(self, tag: str, ends: tuple[str, ...]) -> None:
        stop = _BARRIER.get(tag, SCOPE) - frozenset(ends)
        while (found := self._last(ends)) > self._last(stop):
            if ends == ("p",) and self.blocks and self.blocks[-1] > found:
                return
            self.close_to(found)
            if tag not in ("tr", "thead", "tbody", "tfoot", "td", "th"):
                return

    def end(self, tag: str) -> None:
        found = self._last((tag,))
        if found >= 0 and (tag in TABLE_PARTS or found > self._last(("table",))):
            self.close_to(found)
            return
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.hidden:
            self.lines[-1].line_break(2)

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, hides, closed, invisible = self.open.pop()
            self.at[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()
            self.hidden -= closed
            if not self.hidden:
                self._leave(tag)
            self.hidden -= hides - closed
            self.invisible = invisible

    # ---- layout ----
    def text(self, data: str) -> None:
        if self.hidden or self.invisible:
            return
        data = _html.unescape(data) if "&" in data else data
        if self.tables and not self.tables[-1]["in_cell"]:
            if data.strip(" \t\n\r\f"):  # text between cells is shown before the table
                self.tables[-1]["outside"].append(_BLANKS.sub(" ", data).strip(" "))
            return
        self.lines[-1].add(data, bool(self.pre))

    def _void(self, tag: str) -> None:
        if tag == "br":
            self.lines[-1].forced_break()
        elif tag == "hr":
            self.lines[-1].line_break(2)

    def _enter(self, tag: str, attrs: str) -> None:
        out = self.lines[-1]
        if self.flat or tag == "table" and len(self.tables) >= TABLE_DEPTH:
            # tables within that many others: rows and cells are blocks
            self.flat += tag == "table"
            if tag in TABLE_PARTS:
                out.line_break(2 if tag == "table" else 1)
                return
        if tag == "table":
            out.line_break(2)
            self.tables.append({"rows": [], "in_cell": False, "outside": [], "lists": self.lists})
            self.lists = []
            return
        if tag in ("td", "th", "caption") and self.tables:
            t = self.tables[-1]
            if tag != "caption" and not t["rows"]:
                t["rows"].append([])
            t["in_cell"], t["attrs"] = True, attrs
            self.lines.append(_Lines())
            return
        if tag == "tr" and self.tables and not self.tables[-1]["in_cell"]:
            self.tables[-1]["rows"].append([])
            return
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and self.lists
            out.line_break(2 if tag in SPACED and not nested else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            m = re.search(r"""\bstart\s*=\s*["']?(-?\d{1,9})""", attrs) if tag == "ol" and attrs else None
            self.lists.append([tag, int(m[1]) - 1 if m else 0, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0, 0]
            kind[1] += 1
            mark = f"{kind[1]}. " if kind[0] == "ol" else "* "
            kind[2] = len(mark)
            out.indent += len(mark)
            out.mark = mark
        elif tag in ("dd", "blockquote"):
            out.indent += 2
        elif tag == "pre":
            self.pre += 1

    def _leave(self, tag: str) -> None:
        out = self.lines[-1]
        if self.flat and tag in TABLE_PARTS:
            self.flat -= tag == "table"
            out.line_break(2 if tag == "table" else 1)
            return
        if tag == "table" and self.tables:
            t = self.tables.pop()
            self.lists = t["lists"]
            for piece in [*t["outside"], _table(t["rows"])]:
                if piece:
                    out.line_break(1)
                    out.add(piece, True)
            out.line_break(2)
            return
        if tag in ("td", "th", "caption") and self.tables and self.tables[-1]["in_cell"]:
            text, t = self.lines.pop().text(), self.tables[-1]
            t["in_cell"] = False
            if tag == "caption":
                if text:
                    t["outside"].append(text)
            else:
                t["rows"][-1].append((text, min(SPAN, max(1, _span("colspan", t["attrs"]))), max(1, _span("rowspan", t["attrs"]))))
            return
        if tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0, 2]
            out.indent = max(0, out.indent - kind[2])
            out.mark = ""
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag in ("dd", "blockquote"):
            out.indent = max(0, out.indent - 2)
        elif tag == "pre":
            self.pre -= 1
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and self.lists
            out.line_break(2 if tag in SPACED and not nested else 1)


def _span(name: str, attrs: str) -> int:
    m = re.search(rf"""\b{name}\s*=\s*["']?(\d{{1,5}})""", attrs, re.I) if attrs else None
    return int(m[1]) if m else 1


def _hides(tag: str, attrs: str) -> bool:
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return tag == "dialog" and not re.search(r"\bopen\b", low)
    found = {n.lower(): (v or "").strip("\"'").lower() for n, v in _ATTR.findall(attrs)}
    style = re.sub(r"\s", "", found.get("style", ""))
    return (
        ("hidden" in found and found["hidden"] != "until-found")
        or "display:none" in style
        or (tag == "input" and found.get("type") == "hidden")
    )


def _invisible(attrs: str, inherited: bool) -> bool:
    """Whether an element's own text is invisible: the last visibility that its style names, else what it inherits."""
    found = {n.lower(): (v or "").strip("\"'").lower() for n, v in _ATTR.findall(attrs)}
    named = re.findall(r"(?:^|;)visibility:(hidden|collapse|visible|initial)", re.sub(r"\s", "", found.get("style", "")))
    return named[-1] in ("hidden", "collapse") if named else inherited


def render(page: str | None) -> str:
    """Visible text of one page; null and empty pages have none."""
    if not page:
        return ""
    out, at, n = Renderer(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            out.end(tag)
            continue
        out.start(tag, m[3])
        if tag in RAW:
            e = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = e.end() if e else n
            out.end(tag)
    out.close_to(0)
    return out.page.text()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines), one row per input row.

    Null and empty pages have no text and no lines; repeated rows and rows
    without an id are rendered each. Long pages are rendered whole, in time and
    space in proportion to their length; the text's order is the page's (text
    between the cells of a table comes before the table). Other columns,
    whatever their names, are left aside; an empty table gives an empty one.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [render(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                ["page_id", "text", "n_chars", "n_lines"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
