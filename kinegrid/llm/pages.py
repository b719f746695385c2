"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line's weight is the length of its text, without link text
outside the article, times a prior: more inside ``<article>`` or ``<main>``, next to nothing for lines of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, or outside the article where a page has one. Weights are summed over sliding
windows of lines. The page's own distribution of these sums is split in two (the split with the greatest variance between its sides,
of the sums' logarithms); the text surges where a window reaches the split, and dives at the end of the last one that does. The text between
a surge and its dive is kept, but for lines of next to no weight. Blocks whose peak is far below the page's highest are dropped.
The priors alone keep nothing and drop nothing: a long marked block can reach the split, and unmarked crumbs do not.

Defined cases: a null or empty page has an empty text; unclosed tags, comments and scripts end with the page; very long
pages are read whole; repeated rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
#: Priors of lines inside an article, and of marked ones or those outside the article.
INSIDE, MARKED = 64.0, 1 / 400
#: Bounds of the split, and the share of it that a line of a kept block needs.
SPLIT, LINE_SHARE = (12.0, 48.0), 1 / 12
#: A block is kept whose peak window has so much weight, or this share of the highest peak.
PEAK, PEAK_SHARE = 80, 0.25
#: Fixed values of HTML: elements without text of the page, elements that do not end a line, elements that never have content.
SILENT = frozenset("script style template noscript svg math head title iframe object canvas audio video textarea select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset(["br", "td", "th"])
CLOSED_BY_BLOCK = "p"
ARTICLE = frozenset(["article", "main"])
#: Words of element names, classes, ids and roles that mark what is not the article.
BOILERPLATE_ELEMENTS = frozenset("nav footer aside form button menu dialog fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner nav navbar navigation menu sidebar footer comment comments disqus discussion notice notices "
    "cookie cookies consent gdpr popup modal overlay promo promoted promotion related recommended share sharing social breadcrumb breadcrumbs pagination pager "
    "subscribe subscription newsletter signup login search widget sponsor sponsored toolbar copyright respond replies alert disclaimer masthead topbar".split()
)
HEADER_WORDS = frozenset(["header", "head"])
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE_ELEMENTS or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", *ARTICLE):
        return False
    for kind, *values in NAMED.findall(attributes):
        value = "".join(values).lower()
        if kind.lower() == "role":
            if value.strip() in BOILERPLATE_ROLES:
                return True
            continue
        found = set(re.split(r"[^a-z0-9]+", value))
        if found & BOILERPLATE_WORDS or not in_article and found & HEADER_WORDS:
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters of links, boilerplate, in an article) of each line with text."""
    found: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements that are not inline, and whether they are boilerplate
    marked = inside = links = 0  # open boilerplate elements, articles and links
    run: list[str] = []
    linked = 0

    def end_line() -> None:
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                found.append((text, linked, marked > 0, inside > 0))
        run, linked = [], 0

    def leave(depth: int) -> None:
        nonlocal marked, inside
        for name, flag in stack[depth:]:
            marked -= flag
            inside -= name in ARTICLE
        del stack[depth:]

    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                run.append(m[0])
                linked += len(m[0]) if links else 0
            continue
        if name in SILENT:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                if name in ("textarea", "select"):
                    run.append(" ")
            continue
        if name in SPACED:
            run.append(" ")
        if name in INLINE or name in VOID and name != "hr":
            if name == "a":
                links = 0 if m[1] else 1
            elif not m[1] and name not in VOID and _is_boilerplate("", m[3], inside > 0):
                stack.append((name, True))
                marked += 1
            elif m[1] and stack and stack[-1][0] == name:
                flush = run
                if "".join(flush).strip():
                    end_line()
                leave(len(stack) - 1)
            continue
        if name in ("td", "th"):
            continue
        end_line()
        links = 0
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                leave(depth)
        elif name != "hr" and not m[3].endswith("/"):
            if stack and stack[-1][0] == CLOSED_BY_BLOCK:
                leave(len(stack) - 1)
            flag = _is_boilerplate(name, m[3], inside > 0)
            stack.append((name, flag))
            marked += flag
            inside += name in ARTICLE
    end_line()
    return found


def line_weights(found: list[tuple[str, int, bool, bool]]) -> list[float]:
    has_article = any(inside and not flag for _, _, flag, inside in found)
    weights = []
    for text, linked, flag, inside in found:
        prior = MARKED if flag or has_article and not inside else INSIDE if inside else 1.0
        weights.append(prior * (len(text) if inside else max(0, len(text) - linked)))
    return weights


def split(sums: list[float]) -> float:
    """The middle between the two sides of the sums' logarithms with the greatest variance between them, within SPLIT."""
    logs = sorted(math.log1p(x) for x in sums)
    total, left, best, at = sum(logs), 0.0, 0.0, 0.0
    for k in range(1, len(logs)):
        left += logs[k - 1]
        between = k * (len(logs) - k) * (left / k - (total - left) / (len(logs) - k)) ** 2
        if between > best:
            best, at = between, math.expm1((logs[k - 1] + logs[k]) / 2)
    return min(max(at, SPLIT[0]), SPLIT[1])


def main_text(page: str | None) -> str:
    """The kept lines, joined by an empty line."""
    found = lines(page or "")
    weights = line_weights(found)
    n = len(weights)
    total = list(itertools.accumulate(weights, initial=0.0))
    windows = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    highest = max(windows, default=0.0)
    level = max(1.0, min(split(windows), highest / 2))  # a page of a few short lines is judged by its own peak
    kept: list[str] = []
    i = end = 0
    while i < n:
        surge = i
        while i < n and windows[i] >= level:
            i += 1
        if i > surge and max(windows[surge:i]) >= min(PEAK, PEAK_SHARE * highest):
            kept += [found[k][0] for k in range(max(surge, end), min(n, i + WINDOW - 1)) if weights[k] >= LINE_SHARE * level]
            end = min(n, i + WINDOW - 1)
        i += i == surge
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, *, source: str = "html", into: str = "text") -> DataFrame:
    """All columns but ``source``, and the main text of each page."""
    kept = [c for c in pages.columns if c not in (source, into)]
    rows = pages.select(*kept, F.col(source).cast("string").alias(source))
    schema = T.StructType([*(f for f in rows.schema if f.name in kept), T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, into])

    return rows.mapInArrow(run, schema)
