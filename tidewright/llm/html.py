"""Main text of web pages by the distribution of text over blocks of lines.

1. Markup is stripped by one linear scan. Every block element starts a new line; text inside a block
   becomes one line with single spaces. What can't be the main text by its markup leaves no text but a gap
   of empty lines: scripts, styles, forms, menus, headers, footers, sidebars, and elements whose class,
   id or role names an advert, a notice, comments and the like. Where a page marks its article or main
   part, lines outside of it count as such gaps too; an article that is itself named a comment, an advert or
   the like is no such part. A named element that holds the page's main part or most of its text is a
   wrapper whose name says something else (has-sidebar, header-fixed); see wrappers().
2. The text length of a line with its BLOCK - 1 followers is the line's block length. A surge point is a
   line whose block length rises above SURGE (with lines of text after it), a dive point the next
   line at which it falls to nothing. The text between a surge and its dive is a region. SURGE is the same on
   marked and other pages; a page on which nothing surges is taken from any text on.
3. The main text runs from the first to the last region with a fair share of the longest region's text, and on
   to regions without a surge of their own that follow or lead up to it: across one gap, in a marked part across
   any number, as gaps there only cut out what isn't text. Short regions in that stretch are kept, and none
   that consists of links.

Edges. Null and empty pages, and pages without text, give the empty text; an empty table gives an empty result;
equal rows are extracted each alone; other columns are left out, whatever their names. Time and memory follow a
page's length, however long it is. Tags that are never closed end with the element around them; embedded
ones (svg, video and the like) without any end tag after them hold nothing. Quotes count in a tag only around a
value, after the equals sign; one that is never closed is a letter. Nested or repeated article elements are
one main part each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: Lines in a block, least block length of a surge, and a region's least share of the longest.
BLOCK, SURGE, SHARE = 3, 40, 0.2
#: Letters outside of links of which more are a paragraph.
PARAGRAPH = 3 * SURGE
#: Element names of HTML by their part in a page.
RAW = {"script", "style", "textarea", "title"}
EMBEDDED = {"noscript", "template", "svg", "math", "iframe", "object", "select", "canvas", "audio", "video"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "label"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that an end tag of another kind inside of them doesn't close.
_FENCES = BLOCKS | ASIDE
#: Parts of class, id and role names of what isn't main text: adverts, readers' words, notices and footers, and lists of links.
_READERS = r"(?:comments?(?:list|section|area|box|thread|form|wrap|container)?|disqus|repl(?:y|ies)|responses?|discussions?)"
_HARD = (
    r"(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|comments?(?:list|section|area|box|thread|form|wrap|container)?|disqus|replies|"
    r"cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|footer|copyright|contentinfo)"
)
_LISTS = r"(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|sidebar|side-bar|widget|related|recommended|share|sharing|social|search|login|toolbar|pagination|pager|complementary)"
_NAMES = rf"(?:{_HARD}|{_LISTS})"
NAMED = re.compile(rf"(?:^|[\s_-]){_NAMES}(?:$|[\s_-]|\d)", re.I)
#: The whole of a class, id or role consists of such names.
EXACT = re.compile(rf"(?:^|\s){_NAMES}(?:[_-]{_NAMES})*(?:$|\s)", re.I)
#: Names that no amount of text excuses.
HARD = re.compile(rf"(?:^|[\s_-]){_HARD}(?:$|[\s_-]|\d)", re.I)
#: Names that part an article or main element from the page's own: readers' words, in part or whole.
READERS = re.compile(rf"(?:^|[\s_-]){_READERS}(?:$|[\s_-]|\d)", re.I)
#: The whole of an element's class, id or role is a name of readers' words.
ONLY_READERS = re.compile(rf"\s*{_READERS}\s*", re.I)
#: Where a name in camel case has its parts.
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
#: The inside of a tag: runs of anything else, and values, which alone have quotes.
_INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:-->|\Z))|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_NAMING = {"class", "id", "role"}


class Named:
    """An element with an aside's name: the named one around it, its offset, its name (soft: one of a list of links), and unlinked letters
    in it (text), in it and inside a marked main part (main), and of main parts that begin in it (held)."""

    def __init__(self, parent: int, offset: int, exact: bool, in_main: bool, soft: bool = False):
        self.parent, self.offset, self.exact, self.in_main, self.soft = parent, offset, exact, in_main, soft
        self.text = self.main = self.held = 0


def wrappers(named: list[Named]) -> frozenset[int]:
    """Offsets of named elements that are wrappers of the page's main text, found from the page inwards.

    In a wrapper (or the page) a named element is one if it holds more than half of the text, enough for a region, and is named so in
    part only (in a main part: like a list of links), or nothing worth a region is left outside of it. Where nothing is left outside, one that
    holds a main part is as well; one by an exact name only where no other is. Within a main part an element that is named like a list of links
    but holds a paragraph without links (PARAGRAPH letters) is no such list. Beside a marked main part with text of its own only elements inside that count."""
    every, held = [x.text for x in named], [x.held for x in named]
    for i in range(len(named) - 1, 0, -1):
        every[named[i].parent] += every[i]
        held[named[i].parent] += held[i]
    children: dict[int, list[int]] = {}
    for i in range(1, len(named)):
        children.setdefault(named[i].parent, []).append(i)
    out, todo = set(), [0]
    while todo:
        at = todo.pop()
        around = named[at]
        alone = around.text <= SURGE
        some = [i for i in children.get(at, ()) if named[i].in_main or not around.main]
        holders = sum(held[i] > 0 for i in some)
        chosen: list[int] = []
        for exact in (False, True):
            if not chosen:
                for i in some:
                    most = every[i] > SURGE and 2 * every[i] > every[at] and (alone or not exact and (named[i].soft or not named[i].in_main))
                    if named[i].exact == exact and (most or held[i] and alone and (not exact or holders == 1)):
                        chosen.append(i)
        chosen += [i for i in some if i not in chosen and named[i].in_main and named[i].soft and named[i].text > PARAGRAPH]
        out.update(named[i].offset for i in chosen)
        todo += chosen
    return frozenset(out)


class Element:
    """An open element: its name, whether it is an aside, a link, a marked main part (as the page's text
    and as what holds text), whether its aside has no name, and its place in the list of named ones or 0."""

    __slots__ = ("name", "aside", "hard", "main", "inner", "place")

    def __init__(self, name: str, aside: bool, hard: bool, main: bool, inner: bool, place: int):
        self.name, self.aside, self.hard, self.main, self.inner, self.place = name, aside, hard, main, inner, place


class Lines:
    """The lines of a page, (text, letters inside links, inside a marked main part); a gap is (None, 0, main).

    Elements that start at an offset in ``exempt`` are no asides whatever their names are."""

    def __init__(self, html: str, exempt: frozenset[int] = frozenset()):
        self.lines: list[tuple[str | None, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        # The open elements (None where an end tag has closed one below an open block), and their places by name.
        self.open: list[Element | None] = []
        self.where: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.asides = self.mains = self.links = 0
        # The page and its named asides, with the text in them that no other aside holds; hard counts the other asides.
        self.named = [Named(-1, -1, False, False)]
        self.hard = self.within = self.inner = 0
        home = at = 0
        last: dict[str, int] = {}
        search, n = _TOKEN.search, len(html)
        while at < n:
            m = search(html, at)
            text = html[at : m.start() if m else n]
            if text and not self.asides:
                self.parts.append(text)
                if self.links:
                    self.linked += len(text)
            if text and not self.hard and not self.links:
                size = len(text) if not text.isspace() else 0
                self.named[self.within].text += size
                if self.inner:
                    self.named[self.within].main += size
                    self.named[home].held += size
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.end_tag(name)
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
                continue
            if name == "br" or name == "wbr":
                self.parts.append(" " if name == "br" else "")
                continue
            if name in EMBEDDED and name not in last:
                last[name] = max((c.start() for c in re.finditer(rf"</{name}(?=[\s/>])", html, re.I)), default=-1)
            if name in EMBEDDED and last[name] < at:
                continue
            if name in VOID or m[3].endswith("/") and name not in BLOCKS:
                if name == "hr":
                    self.end()
                continue
            self.close_before(name)
            kind, soft, role = self.kind(m[3], name) if m[3] and name not in ASIDE and name not in EMBEDDED else ("", False, False)
            if kind in ("exact", "part") and m.start() in exempt:
                kind = ""
            place = 0
            if kind in ("exact", "part") and not self.hard:
                place = len(self.named)
                self.named.append(Named(self.within, m.start(), kind == "exact", self.inner > 0, soft))
                self.within = place
            aside = name in ASIDE or name in EMBEDDED or bool(kind)
            if name in BLOCKS or aside and name not in EMBEDDED:
                self.end()
            if aside:
                self.asides += 1
                self.hard += not place
                if name not in EMBEDDED:
                    self.gap(self.mains > 0)
            marked = name in MAIN or role
            inner = marked and not self.hard and not place
            if inner:
                if not self.inner:
                    home = self.within
                self.inner += 1
            main = marked and not self.asides
            if main:
                self.gap(False)
                self.mains += 1
            self.links += name == "a"
            if name in _FENCES:
                self.fences.append(len(self.open))
            self.where.setdefault(name, []).append(len(self.open))
            self.open.append(Element(name, aside, aside and not place, main, inner, place))
        self.end()

    @staticmethod
    def kind(attributes: str, name: str) -> tuple[str, bool, bool]:
        """What its attributes make of an element: hidden, an aside by an exact name or by a part of one, or nothing; whether that name is one of a
        list of links; whether its role is that of a main part.

        An article or main element goes by readers' names, and by others only if they are all of its name."""
        if name in ("html", "body"):
            return "", False, False
        found = [(key.lower(), "".join(values)) for key, *values in _ATTRIBUTE.findall(attributes)]
        role = name in BLOCKS and ("role", "main") in found
        out, soft = "", True
        for key, value in found:
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
                return "" if name in MAIN else "hidden", False, role
            if key in _NAMING and out != "exact":
                value = _CAMEL.sub("-", value)
                exact = bool(EXACT.search(value))
                if NAMED.search(value) or ONLY_READERS.fullmatch(value) if name not in MAIN and not role else exact or READERS.search(value):
                    out = "exact" if exact else "part"
                    soft = soft and not HARD.search(value) and not READERS.search(value)
        return out, bool(out) and soft, role

    def close(self, i: int) -> None:
        """End the open element at place i; it stays in the list as None if others are above it."""
        e = self.open[i]
        self.where[e.name].pop()
        if i == len(self.open) - 1:
            self.open.pop()
            while self.open and self.open[-1] is None:
                self.open.pop()
        else:
            self.open[i] = None
        if e.name in _FENCES:
            self.end()
            if self.fences[-1] == i:
                self.fences.pop()
        self.asides -= e.aside
        self.hard -= e.hard
        self.inner -= e.inner
        self.links -= e.name == "a"
        if e.place:
            self.within = self.named[e.place].parent
        if e.main:
            self.mains -= 1
            self.gap(False)

    def end_tag(self, name: str) -> None:
        """Close the innermost open element of that name with all in it; one that isn't a block, from within a
        block that it holds, alone. Without one it ends the line, if it is a block's."""
        places = self.where.get(name)
        if not places:
            if name in BLOCKS:
                self.end()
            return
        i = places[-1]
        if name not in _FENCES and name not in EMBEDDED and self.fences and self.fences[-1] > i:
            self.close(i)
            return
        while len(self.open) > i:
            self.close(len(self.open) - 1)

    def close_before(self, name: str) -> None:
        """A new block closes an open paragraph around it, a new item the item before it."""
        closes = ("p",) if name in _FENCES else ()
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            closes = ("p", name)
        for c in closes:
            i = self.where[c][-1] if self.where.get(c) else -1
            # No other block stands between.
            if i >= 0 and self.fences and self.fences[-1] <= i:
                while len(self.open) > i:
                    self.close(len(self.open) - 1)

    def end(self) -> None:
        """Close the line that is open, if it has text."""
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                self.lines.append((text, self.linked, self.mains > 0))
            self.parts.clear()
        self.linked = 0

    def gap(self, main: bool) -> None:
        self.end()
        self.lines += [(None, 0, main)] * BLOCK


def regions(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of each stretch from a surge point to its dive point."""
    n, out, at = len(lengths), [], 0
    blocks, running = [0] * n, 0
    for i in range(n - 1, -1, -1):
        running += lengths[i] - (lengths[i + BLOCK] if i + BLOCK < n else 0)
        blocks[i] = running
    while at < n:
        if lengths[at] and blocks[at] > surge:
            dive = at
            while dive < n and blocks[dive]:
                dive += 1
            while at and lengths[at - 1] and (not out or at > out[-1][1]):
                at -= 1  # short lines that lead up to the surge
            end = dive
            while not lengths[end - 1]:
                end -= 1
            out.append((at, end))
            at = dive
        else:
            at += 1
    return out


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by one space."""
    if not html:
        return ""
    page = Lines(html)
    if exempt := wrappers(page.named):
        page = Lines(html, exempt)
    lines = page.lines
    marked = any(main and text for text, _, main in lines)
    lengths = [len(text) if text and (main or not marked) else 0 for text, _, main in lines]
    surges = set(regions(lengths, SURGE))
    found = regions(lengths, 0)
    weigh = [sum(lengths[a:b]) for a, b in found]
    free = [sum(max(0, lengths[i] - lines[i][1]) for i in range(a, b)) for a, b in found]
    real = [2 * f >= w for f, w in zip(free, weigh, strict=True)]
    if not any(real):
        # Only links, or no text at all: a marked part is what its page says that it is.
        return " ".join(text for (text, _, _), n in zip(lines, lengths, strict=True) if n) if marked else ""
    strong = [r and x in surges for x, r in zip(found, real, strict=True)]
    strong = strong if any(strong) else real
    top = max(w for w, s in zip(weigh, strong, strict=True) if s)
    fair = [i for i, (w, s) in enumerate(zip(weigh, strong, strict=True)) if s and w >= SHARE * top]
    first, last = fair[0], fair[-1]
    reach = len(lines) if marked else BLOCK
    while first and real[first - 1] and found[first][0] - found[first - 1][1] <= reach:
        first -= 1
    while last + 1 < len(found) and real[last + 1] and found[last + 1][0] - found[last][1] <= reach:
        last += 1
    kept = [x for x, r in zip(found[first : last + 1], real[first : last + 1], strict=True) if r]
    return " ".join(lines[i][0] for a, b in kept for i in range(a, b) if lengths[i])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html, and more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all pages."""
    return extract(read(spark, sf_dir, "pages"))
