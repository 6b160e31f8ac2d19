"""Operator 10: the main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block element; scripts and styles go with what they hold. The masses of the lines
are summed over a sliding window; a stretch of lines is text where that sum surges, and ends where it dives.

The mass of a line is its length times a weight that markup gives it. From the lightest: furniture (menus, page headers,
footers, sidebars, adverts, notices, forms, reader comments), lines that nothing marks, an article inside a part that a
layout class marks, a main element. A character outweighs all lighter lines of its page together, so that a main element
surges however short it is, and beside it the distribution dives at a block without such a mark, however long that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ship_code, table

#: Lines in a window, and the characters without a mark that surge; on a page without so many, as many as its fullest has.
WINDOW, SURGE = 3, 80

RAW = frozenset("script style noscript template iframe svg math object textarea select title xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in a class, id or role that mark furniture, alone or with PLACES and each other ("site-header", "cookie_notice").
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal "
    "overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar complementary contentinfo comment comments disqus respond "
    "reply replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget".split()
)
PLACES = frozenset("site page main global top bottom left right primary secondary wrapper wrap container box bar block area section list item inner outer slot unit form thread reader user".split())
#: Hints that hold for articles and main elements, too, and for articles in them.
NOT_MAIN = frozenset("ad ads adbox advert adverts advertisement advertising comment comments disqus reply replies related recommended promo promotion sponsor sponsored".split())
MAIN = frozenset(("article", "main"))

# Possessive, so that a tag is read once: its name, then attributes with closed quotes. From the first tag of a page that
# has none of these on, which is read to the end in vain, tags go up to the next ">".
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PARTS = re.compile(r"[^\W_]+")
_LONG_NUMBER = re.compile(r"&#0*+(\d*+);?")
#: Levels of lines, from the lightest.
LEVELS = FURNISHED, PLAIN, HELD, MARKED = range(4)


def hints(attributes: str) -> set[str]:
    """The hints among the whole names of class, id and role."""
    found: set[str] = set()
    if "=" in attributes:
        for m in _MARKS.finditer(attributes):
            value = next(x for x in m.groups() if x is not None)
            for name in value.lower().split():
                parts = set(_PARTS.findall(name))
                if parts & HINTS and parts <= HINTS | PLACES:
                    found |= parts & HINTS
            if value.strip().lower() == "main":
                found.add("main")
    return found


def _decoded(piece: str) -> str:
    if "&" not in piece:
        return piece
    if "&#" in piece:  # numbers beyond every character, however long
        piece = _LONG_NUMBER.sub(lambda m: m[0] if not m[1] else f"&#{m[1]};" if len(m[1]) < 8 else "�", piece)
    return unescape(piece)


@dataclass(slots=True)
class Line:
    text: str
    mass: int  # its length, outside of main elements and headings without links
    level: int
    region: int  # which main element, from 1; 0 outside


@dataclass(slots=True)
class _Open:
    """A furniture, hinted or main element that is open, and how many of its name are in it."""

    name: str
    kind: str
    hard: bool
    depth: int = 1


def lines_of(html: str) -> list[Line]:
    """The page's non-empty lines in order. Every character is read a fixed number of times.

    Furniture within a line is a line of its own before it.
    """
    lines: list[Line] = []
    parts: list[str] = []
    furnished: list[str] = []
    linked = heading = at = region = 0
    stack: list[_Open] = []
    names: dict[str, int] = {}  # of the stack
    kinds = {"furniture": 0, "hint": 0, "main": 0, "held": 0, "hard": 0}
    in_link, quotes = False, True

    def flush() -> None:
        nonlocal linked
        if furnished and (text := " ".join("".join(furnished).split())):
            lines.append(Line(text, len(text), FURNISHED, 0))
        furnished.clear()
        if parts:
            if text := " ".join("".join(parts).split()):
                main = kinds["main"] + kinds["held"] > 0
                mass = len(text) if main or heading else max(0, len(text) - linked)
                lines.append(Line(text, mass, MARKED if kinds["main"] else HELD if main else PLAIN, region if main else 0))
        parts.clear()
        linked = 0

    def push(name: str, kind: str, hard: bool = False) -> None:
        stack.append(_Open(name, kind, hard))
        names[name] = names.get(name, 0) + 1
        kinds[kind] += 1
        kinds["hard"] += hard

    def pop() -> None:
        gone = stack.pop()
        names[gone.name] -= 1
        kinds[gone.kind] -= 1
        kinds["hard"] -= gone.hard

    while True:
        start = html.find("<", at)
        piece = _decoded(html[at:] if start < 0 else html[at:start])
        if piece and (kinds["furniture"] or kinds["hint"]):
            furnished.append(piece)
        elif piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if start < 0:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if html[start + 1 : start + 2] in ("!", "?"):
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
            continue
        if not re.match("/?[a-zA-Z]", html[start + 1 : start + 3]):
            (furnished if kinds["furniture"] or kinds["hint"] else parts).append("<")
            at = start + 1
            continue
        tag = _TAG.match(html, start) if quotes else None
        if tag is None:
            quotes = False
            tag = _LOOSE.match(html, start)
        if tag is None:  # no tag ends any more
            break
        at = tag.end()
        closing, name, attributes = tag.groups()
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                stop = html.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(html)
            continue
        if name == "a":
            in_link = not closing
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
            in_link = False
            if name in HEADINGS:
                heading = 0 if closing else 1
        if name in VOID:
            continue
        top = stack[-1] if stack else None
        if closing:
            if names.get(name):
                while stack[-1].name != name:  # closed with what holds them
                    pop()
                stack[-1].depth -= 1
                if not stack[-1].depth:
                    pop()
            continue
        if top and top.name == name and name in ("p", "li"):  # ends the open one
            pop()
            top = None
        found = hints(attributes)
        main = (name in MAIN or "main" in found) and not found & NOT_MAIN
        if main and not kinds["hard"]:
            within = kinds["hint"] > 0
            while stack and stack[-1].kind in ("furniture", "hint"):  # a layout class or a page-wide form
                pop()
            region += not kinds["main"] + kinds["held"]
            push(name, "held" if within and name == "article" else "main")
            continue
        if name in FURNITURE and not (name == "header" and kinds["main"] + kinds["held"]):
            push(name, "furniture", name != "form")
            continue
        if not main and (found & NOT_MAIN if name in MAIN or name in ("body", "html") else found):
            push(name, "hint", bool(found & NOT_MAIN))
            continue
        if top and top.name == name:
            top.depth += 1
    flush()
    return lines


def weights(lines: list[Line]) -> list[int]:
    """The weight of a character of each level: more than all lines of lower levels weigh together."""
    weight = [1]
    for level in LEVELS[:-1]:
        weight.append(weight[-1] * (1 + sum(x.mass for x in lines if x.level == level)))
    return weight


def block_sums(masses: list[int]) -> list[int]:
    """The distribution: for each line the mass of the window that it begins."""
    return [sum(masses[i : i + WINDOW]) for i in range(len(masses))]


def stretches(lines: list[Line], level: int) -> list[list[Line]]:
    """The lines of a level and above between dives, without massless ends.

    The distribution dives where a window of these lines has no mass, and between main elements if these count.
    """
    out: list[list[Line]] = [[]]
    massless = 0
    for line in lines:
        if line.level < level:
            continue
        massless = 0 if line.mass else massless + 1
        run = out[-1]
        if run and (massless >= WINDOW or level > PLAIN and line.region != run[-1].region):
            out.append(run := [])
        if line.mass or run:
            run.append(line)
    for run in out:
        while run and not run[-1].mass:
            run.pop()
    return [run for run in out if run]


def main_text(html: str | None) -> str:
    """The text between the surges and dives of the page's line-block distribution, its lines joined by line feeds."""
    lines = lines_of(html or "")
    weight = weights(lines)
    fullest = max(block_sums([x.mass * weight[x.level] for x in lines]), default=0)
    level = max(x for x in LEVELS if x == FURNISHED or weight[x] <= fullest)
    if level == FURNISHED:
        return ""
    least = min(SURGE * weight[PLAIN], fullest) if level == PLAIN else weight[level]
    surging = (run for run in stretches(lines, level) if max(block_sums([x.mass * weight[x.level] for x in run])) >= least)
    return "\n".join(x.text for run in surging for x in run)


def text_column(html: Column) -> Column:
    """The main text of a column of pages; null counts as empty."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return texts(html)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Null html counts as empty; a page without text gives the empty text. Character references are decoded, white space
    inside a block becomes one space, and blocks are joined in page order by one line feed. A tag or comment that never
    ends reaches to the end, as browsers have it; very long pages, however broken, take time in proportion to their
    length. Pages repeat as they are given, ids of any value and null ones stay as they are, an empty table gives no
    rows, and other columns are neither read nor returned. No shuffle: pages are independent of each other.
    """
    ship_code(pages.sparkSession)
    done = pages.select("page_id", "url", text_column(F.col("html")).alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
