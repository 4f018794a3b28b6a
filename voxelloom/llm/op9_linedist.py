"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped so that each block element stands on a line of its own; where
containers end and begin between two lines, empty lines stand for them. The lengths
of the unlinked texts of a few consecutive lines are summed in a sliding window.
Where the sums rise from zero a region begins, where they dive to zero it ends, and a
region is main text if its sums surge: reach the threshold, or are the page's highest.
Names are a prior only: text in elements that are called a menu or an advert, or
that stand beside an article, counts a fiftieth of its length, too little for a surge.
Inside an article no containers part the lines, links count as text, and only what
is called boilerplate is left out. Between the first and the last region that surge,
lines that are no boilerplate by name stay, too.
"""

from __future__ import annotations

import html as html_lib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

WINDOW, SURGE = 3, 86
#: What a character of named boilerplate counts; its lines count too little to surge in a window.
FAINT = 1 / 50
#: Elements whose content is no text.
SILENT = ("script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "head", "textarea", "select", "title", "xmp", "noframes", "audio", "video")
#: Elements that are boilerplate as such.
BOILERPLATE = ("nav", "footer", "aside", "form", "menu", "dialog", "button")
#: Names in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside "
    "widget footer header masthead topbar toolbar comment comments disqus respond replies cookie cookies consent notice notices newsletter subscribe subscription "
    "popup modal overlay share sharing social related recommended pagination pager copyright legal login signup search contentinfo complementary".split()
)
#: Words that stand beside such a name in names like site-footer. With any other, as in social-history, a name marks nothing.
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right upper lower sticky fixed floating mobile desktop list lists item items box bar block wrapper wrap container content area section "
    "panel group inner outer row col column slot unit text links link icons icon buttons button form field posts post articles article entry stories story news user reader thread body title label js".split()
)
#: Elements that end a line.
BLOCKS = frozenset("p br h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr td th table caption blockquote pre hr div section article main header footer nav aside form fieldset figure figcaption address details summary body html option center".split())
#: Elements that hold others; outside an article, each border between two lines is an empty line.
CONTAINERS = frozenset("div section ul ol dl table main article header footer nav aside form fieldset details center".split())
#: Elements that never have content.
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")


def names_boilerplate(name: str) -> bool:
    """Is the name, like `ad` or `site-footer`, made of boilerplate and words beside it? Headers of an article are its own."""
    parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if x]
    parts = [x.lower() for x in parts]
    if not any(x in MARKS for x in parts) or not all(x in MARKS or x in BESIDE or x.isdigit() for x in parts):
        return False
    return not ({"header", "title"} & set(parts) and {"article", "entry", "post", "story", "content", "section"} & set(parts))


def marked(attributes: str) -> bool:
    """Do class, id or role name boilerplate, or does the element hide itself?"""
    if not attributes:
        return False
    names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).split()
    return any(map(names_boilerplate, names)) or bool(_HIDDEN.search(attributes))


class Line(NamedTuple):
    """text and how much of it is linked; named: in boilerplate by name; inside: in an
    article or main element; gap: empty lines before it."""

    text: str
    linked: int
    named: bool
    inside: bool
    gap: int


def text_lines(page: str) -> list[Line]:
    lines: list[Line] = []
    parts: list[str] = []
    linked = gap = 0
    skip: list[str] = []  # open elements of the tag with which boilerplate began
    content, anchor = 0, False

    def end_line() -> None:
        nonlocal linked, gap
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append(Line(text, min(linked, len(text)), bool(skip), content > 0, min(gap, WINDOW)))
            gap = 0
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html_lib.unescape(raw)
            parts.append(text)
            if anchor:
                linked += len(text.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SILENT and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "head":
                end = end or re.compile(r"(?=<body[\s>])", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            anchor = not closing
        if tag in BLOCKS:
            end_line()
        if tag in CONTAINERS and not content:
            gap += 1
        if tag in ("article", "main"):
            content = max(0, content + (-1 if closing else 1))
            if content == (0 if closing else 1):
                gap = WINDOW
        if tag in VOID:
            continue
        if skip:
            if not closing:
                if tag == skip[0]:
                    skip.append(tag)
            elif tag == skip[0]:
                end_line()
                skip.pop()
                if not skip and not content:
                    gap = WINDOW
        elif not closing and (tag in BOILERPLATE or (tag == "header" and not content) or (tag not in ("body", "html", "article", "main") and marked(m[3]))):
            end_line()
            skip.append(tag)
            if not content:
                gap = WINDOW
    say(page[at:])
    end_line()
    return lines


def weight(line: Line, has_article: bool) -> float:
    """What a line counts in the windows."""
    if line.inside and not line.named:
        return len(line.text)
    free = len(line.text) - line.linked
    if line.named or has_article:
        return min(free * FAINT, SURGE / (WINDOW + 1))
    return free


def regions(weights: list[float], gaps: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, highest window sum) of each line: runs of positive sums over `window` lines
    of the page, empty ones among them. Lines of no weight that no window reaches are in region -1."""
    at = np.cumsum(np.array(gaps) + 1) - 1
    page = np.zeros(int(at[-1]) + 1)
    page[at] = weights
    sums = np.convolve(page, np.ones(window))  # sums[i]: lines i - window + 1 to i
    up = np.concatenate([[False], sums > 0])
    number = np.cumsum(up[1:] & ~up[:-1]) - 1
    highest = np.zeros(int(number[-1]) + 1)
    np.maximum.at(highest, number[sums > 0], sums[sums > 0])
    mine = np.where(sums[at] > 0, number[at], -1)
    return mine, np.where(mine >= 0, highest[mine] if len(highest) else 0.0, 0.0)


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text: blocks in page order, joined by one space. Null or empty
    pages and pages of boilerplate alone give an empty text; of several regions
    with the same highest sum, each counts."""
    lines = text_lines(page or "")
    has_article = any(x.inside and not x.named for x in lines)
    own = np.array([not x.named and (x.inside or not has_article) for x in lines], bool)
    if not own.any():
        return ""
    region, highest = regions([weight(x, has_article) for x in lines], [x.gap for x in lines], window)
    kept = (highest >= surge) & (region >= 0)
    if not (kept & own).any():  # a short page: its highest region
        kept |= own & (highest == highest[own].max())
    where = np.flatnonzero(kept)
    between = np.zeros(len(lines), bool)
    between[where[0] : where[-1] + 1] = True
    link = [x.linked * 2 > len(x.text) and not x.inside for x in lines]
    menu = [link[i] and ((i > 0 and link[i - 1]) or (i + 1 < len(link) and link[i + 1])) for i in range(len(link))]
    return " ".join(x.text for i, x in enumerate(lines) if ((kept[i] and not (x.named and x.inside)) or (between[i] and own[i])) and not menu[i])


def page_texts(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for each row of pages, repeated ones too. A null or
    empty html has an empty text; a null id or url stays null; other columns are ignored."""

    def work(it):
        for batch in it:
            texts = [main_text(h, window, surge) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select("page_id", "url", "html")
    return p.mapInArrow(work, f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op9_linedist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))
