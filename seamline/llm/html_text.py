"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one for each block of text. A line weighs what it
has of text outside links, more in an element that the page declares to be its
article; a line that is mostly links, or outside such an element, weighs
against. Weights are summed over windows of lines: the sum surges where the
article begins and dives where it ends, and the lines between that weigh for it
are kept. What an element marks as a menu, header, footer, sidebar, notice,
advert, form, script or comments takes no place in a window, so it doesn't end
the article that it stands in.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.common import Apart, text_rows

#: Lines in a window, and the sum at which a window surges, or this share of the page's greatest sum if that is less.
WINDOW = 3
SURGE = 80
PEAK_SHARE = 0.25
#: What a line in an element declared to be the article weighs beside its text, and what a line against the article weighs.
#: A declared line surges whatever the others in its window are.
AGAINST = -20
DECLARED = SURGE - (WINDOW - 1) * AGAINST
#: A line is mostly links if they hold over this share of its text.
LINKS = 0.6

# Elements of the HTML standard by what they mean here.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_AWAY = frozenset("head nav header footer aside form script style template noscript textarea select button option datalist dialog menu iframe object svg canvas audio video map title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr script style template noscript button select td th".split())
_SPACE = frozenset("br td th img wbr".split())
_DECLARED = frozenset("article main".split())
_P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Words of class, id and role names that mark what is not the article.
_AWAY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promoted|promotion|"
    r"nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|toolbar|topbar|footer|foot|copyright|colophon|"
    r"sidebar|aside|rail|widget|widgets|related|recommended|recommendations|popular|trending|share|sharing|social|follow|"
    r"notice|notices|notification|alert|cookie|cookies|consent|gdpr|disclaimer|popup|modal|overlay|paywall|"
    r"form|login|signin|signup|subscribe|subscription|newsletter|search|"
    r"comment|comments|commentlist|discussion|disqus|replies|reply|respond|reader-comments|complementary|contentinfo|search)(?:$|[\s_-])"
)
#: Those of them that may also stand for a part of an article: they mark no paragraph, heading or the like in one.
_WEAK_NAMES = re.compile(r"(?:^|(?<=[\s_-]))(?:alert|search|follow|foot|form|social|discussion|popular|rail|overlay|notification|notices?|recommendations?|disclaimer|consent|copyright|aside|foot)(?=$|[\s_-])")
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr table ul ol dl blockquote pre figure figcaption section span em strong b i".split())
#: The same where no article is open: an article's own header belongs to it.
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])")
#: Names of layouts say what else is on the page, not what the element is.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|no|without|show|hide)[_-][\w-]+")
_MAIN_NAMES = re.compile(r"(?:^|\s)(?:articlebody|article-body|article_body|article-content|article__body|post-content|post-body|entry-content|main-content|main)(?:$|\s)")
#: Comments, declarations and tags. No part is read twice: what has no end reaches to the end of the page, or isn't a tag at all.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*+)>", re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Ids of headings and sections in an article are anchors made of their titles; only these, whole, are not.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
_COMMENTS = re.compile(r"comments?|comment[_-]?list|reader-comments|disqus(?:_thread)?")
_BODY_LIKE = frozenset("html body".split())


@dataclass
class Line:
    text: str
    linked: int
    away: bool
    declared: bool


def _marks(name: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(is not the article, is declared to be the article) by an element's attributes; inside: of such an element."""
    away = main = False
    for m in _NAMED.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            if key == "id" and inside and name in _ANCHORED and not _COMMENTS.fullmatch(value.strip()):
                continue
            value = _LAYOUT.sub(" ", value)
            if inside and name in _TEXTUAL:
                value = _WEAK_NAMES.sub(" ", value)
            away = away or bool(_AWAY_NAMES.search(value)) or not inside and bool(_HEADER_NAMES.search(value))
            main = main or bool(_MAIN_NAMES.search(value))
        elif key == "itemprop":
            main = main or value == "articlebody"
        elif key == "aria-hidden":
            away = away or value == "true"
        elif key == "hidden":
            away = True
        elif key == "style":
            away = away or "display:none" in value.replace(" ", "")
    return away and name not in _BODY_LIKE and name not in _DECLARED, main and not away


def lines_of(page: str) -> list[Line]:
    """A page's blocks of text in order, with an empty line wherever blocks end."""
    out: list[Line] = []
    open_: list[tuple[str, bool, bool]] = []  # name, away, declared
    # muted: elements that aren't the article but stand within a block, and leave it whole.
    away = declared = links = muted = 0
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            out.append(Line(whole, min(len(whole), len(" ".join(html.unescape("".join(linked)).split()))), away > 0, declared > 0))
        text.clear()
        linked.clear()

    # Places in open_ by name, and of the elements that aren't inline.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def last(*names: str) -> int:
        """The place of the innermost open element of one of these names, or -1."""
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def close(to: int) -> None:
        nonlocal away, declared, links, muted
        while len(open_) > to:
            name, a, d = open_.pop()
            places[name].pop()
            if name not in _INLINE:
                blocks.pop()
                flush()
                away -= a
            else:
                muted -= a
            declared -= d
            links -= name == "a"

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        said = page[at : m.start() if m else n]
        if said and not muted:
            text.append(said)
            if links > 0:
                linked.append(said)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if (i := last(name)) >= 0:
                close(i)
            elif name not in _INLINE:
                flush()
            continue
        if name in _P_CLOSERS:
            if blocks and open_[blocks[-1]][0] == "p":
                close(blocks[-1])
        elif name in ("li", "dt", "dd", "tr", "option"):
            i = last("dt", "dd") if name in ("dt", "dd") else last(name)
            if i > last(*{"li": ("ul", "ol", "menu"), "tr": ("table",)}.get(name, ("dl", "select"))):
                close(i)
        if name in _SPACE:
            text.append(" ")
        elif name not in _INLINE:
            flush()
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        a, d = _marks(name, m[3] or "", declared > 0) if m[3] and m[3] != "/" else (False, False)
        a = a or name in _AWAY and not (name == "header" and declared)
        d = d or name in _DECLARED
        places.setdefault(name, []).append(len(open_))
        if name in _INLINE:
            muted += a
        else:
            blocks.append(len(open_))
            away += a
        open_.append((name, a, d))
        declared += d
        links += name == "a"
    close(0)
    flush()
    return out


def weights(lines: list[Line]) -> np.ndarray:
    """What each line adds to the sum of a window."""
    declared = any(x.declared for x in lines)

    def weight(x: Line) -> int:
        if not x.declared if declared else x.linked > LINKS * len(x.text):
            return AGAINST
        return len(x.text) + DECLARED if declared else max(1, len(x.text) - x.linked)

    return np.array([weight(x) for x in lines], np.int64)


def regions(w: np.ndarray, surge: float = SURGE, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, last) lines of the regions between a surge and the dive after it, for weights w.

    The sum over a window surges at the first line that weighs for the article
    and whose window reaches `surge`, or PEAK_SHARE of the greatest sum if that
    is less; it dives after the line whose next window has nothing left.
    """
    run = np.concatenate([[0], np.cumsum(np.concatenate([w, np.zeros(window, w.dtype)]))])
    sums = run[window:] - run[:-window]
    out, i, n = [], 0, len(w)
    least = max(1, min(surge, PEAK_SHARE * sums.max(initial=0)))
    while i < n:
        if not (w[i] > 0 and sums[i] >= least):
            i += 1
            continue
        j = i
        while j + 1 < n and sums[j + 1] > 0:
            j += 1
        out.append((i, j))
        i = j + 1
    return out


def main_text(page: str | None) -> str:
    """The article of a page, a line for each block; empty for null, empty and article-less pages."""
    lines = [x for x in lines_of(page or "") if not x.away]
    w = weights(lines)
    return "\n".join(lines[i].text for a, b in regions(w) for i in range(a, b + 1) if w[i] > 0)


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """pages with `text` (string) and `n_chars` (long, its code points) appended.

    Null and empty pages give empty texts; so do pages of boilerplate alone.
    White space inside a block is one space, blocks are joined by one \\n.
    Repeated rows get equal texts; columns of the two names are replaced.
    """
    a = Apart(pages)
    names = a.df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.decode("utf-8", "replace") if p is not None else None) for p in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "_text", "_chars"])

    src = a.df.select(*names, F.col(a.at(markup)).cast("binary").alias("_bytes"))
    made = text_rows(src).mapInArrow(run, T.StructType([*a.df.schema.fields, T.StructField("_text", T.StringType()), T.StructField("_chars", T.LongType())]))
    return a.back(made, text=F.col("_text"), n_chars=F.col("_chars"))
