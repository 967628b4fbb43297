"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. A line's weight is its
text outside links; lines of menus, notices and the like weigh nothing. The sums
of weights over windows of a few lines rise at a surge point and fall to nothing
at a dive point; the text between is kept, but for the lines that weigh nothing
by their place.

Where a page marks its article, lines in it weigh enough for any window to
rise, and lines outside weigh nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoweave.llm.session import ship

# Elements and name parts.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_UNSEEN = frozenset("head noscript template svg math object canvas audio video select datalist button map".split()) | _RAW
_APART = frozenset("nav footer aside form dialog menu fieldset".split())
_KEPT = frozenset("html body main".split())
_CLOSES_P = _BLOCKS - {"br"}
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table menu select".split())
_APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner sidebar sidebars side rail aside nav navbar navigation menu menus topbar breadcrumb breadcrumbs crumbs header masthead footer foot colophon copyright cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup login register search share sharing social related recommended recommendations trending popular widget widgets toolbar pagination pager tags comment comments commentlist respond reply replies disqus discussion reactions disclaimer skip adsbygoogle werbung anzeige publicite publicidad anuncio anuncios hinweis aviso kommentare kommentar commentaires commentaire comentarios comentario".split()
)
_COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion reactions kommentare kommentar commentaires commentaire comentarios comentario".split())
_ARTICLE_NAMES = frozenset("article content main post entry story body text".split())
_JOINING = frozenset("with has no without is".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Line:
    text: str
    plain: int  # code points outside links
    apart: bool
    within: frozenset = field(default_factory=frozenset)  # "article", "main", "named": what marks an article round it


def _parts(name: str) -> list[str]:
    return [x.lower() for x in _PART.findall(name)]


def _is_apart(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element stands apart from the article by its name, role, class or id."""
    names = [_parts(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    if tag in _KEPT:
        return False
    if tag == "article":
        return any(set(n) & _COMMENTS for n in names)
    if tag in _APART or tag == "header" and not in_article:
        return True
    if attributes.get("role", "").lower() in _APART_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    for n in names:
        if n and n[0] not in _JOINING and (n[-1] in _APART_NAMES or n[0] in _APART_NAMES and not set(n) & _ARTICLE_NAMES):
            return True
    return False


def lines(page: str) -> list[Line]:
    """The blocks of text of a page, in order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, str]] = []  # open elements: name, apart, mark
    text: list[str] = []
    plain, in_link, at = 0, 0, 0

    def close_line() -> None:
        nonlocal plain
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Line(joined, min(plain, len(joined)), any(a for _, a, _ in stack), frozenset(m for _, _, m in stack if m)))
            text.clear()
        plain = 0

    def add(raw: str) -> None:
        nonlocal plain
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if not in_link:
                plain += len(raw.strip())

    def pop_to(place: int) -> None:
        close_line()
        del stack[place:]

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m["data"]:
            add(m["data"])
        tag = (m["name"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "p" and not any(t == "p" for t, _, _ in stack):
                close_line()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            else:
                if tag in _BLOCKS:
                    close_line()
            continue
        if tag in _UNSEEN:
            # what is in it is no text: go on after its end tag, nested ones counted
            if tag in _BLOCKS:
                close_line()
            if m["more"].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            depth, close = 1, re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
            if tag == "head":
                close = re.compile(r"<(/)head(?=[\s/>])[^>]*>|<(?=body[\s>])", re.I)
            here = at
            while depth:
                e = close.search(page, here)
                if e is None:
                    if tag in ("script", "style", "textarea"):
                        at = end
                    break
                here = e.end()
                if tag == "head" and not e[1]:
                    here, depth = e.start(), 0
                elif e[1]:
                    depth -= 1
                elif tag not in _RAW:
                    depth += 1
                at = here
            continue
        if tag in _BLOCKS:
            close_line()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i]
                        break
                    if stack[i][0] not in ("span", "a", "b", "i", "em", "strong", "font"):
                        break
            if tag in _SAME:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _SAME[tag]:
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPE:
                        break
        if tag in _VOID or m["more"].rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        attributes = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(m["more"])} if m["more"].strip(" /\n\t") else {}
        apart = _is_apart(tag, attributes, any(x == "article" for _, _, x in stack))
        if tag == "a":
            in_link += 1
            if not apart:
                continue
        mark = tag if tag in ("article", "main") else "main" if attributes.get("role") == "main" else ""
        if not mark and tag in ("div", "section", "td"):
            named = [_parts(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
            mark = "named" if any(n and (n[-1] in _ARTICLE_NAMES or n[0] in _ARTICLE_NAMES) and n[0] not in _JOINING for n in named) else ""
        if tag in _BLOCKS or apart or mark:
            if apart and tag not in _BLOCKS:
                close_line()
            stack.append((tag, apart, mark))
    close_line()
    return out


def surges(weights: list[int], window: int, threshold: float) -> list[tuple[int, int]]:
    """(first, after last) of the stretches from a surge point to a dive point.

    A surge is where the sum of a window's weights comes over the threshold; a
    dive is where it falls to nothing. Lines at the ends that weigh nothing are
    left out.
    """
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    n = len(weights)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if sums[i] > threshold:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            a, b = i, j
            while a < b and not weights[a]:
                a += 1
            while b > a and not weights[b - 1]:
                b -= 1
            out.append((a, b))
            i = j
        else:
            i += 1
    return out


def main_text(page: str | None, window: int = 3, threshold: int = 86) -> tuple[str, list[tuple[int, int]]]:
    """The main text of a page and the stretches of lines it comes from.

    Pages of less text than the threshold are held to half of their largest
    window. Every stretch stays, however short it is beside the largest.
    """
    found = lines(page or "")
    marked = next((m for m in ("article", "main", "named") if any(m in x.within and not x.apart for x in found)), None)
    weights = []
    for x in found:
        inside = marked is None or marked in x.within
        w = 0 if x.apart or not inside else x.plain
        if marked in ("article", "main") and inside and not x.apart:
            w += threshold + 1
        weights.append(w)
    most = max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)
    parts = surges(weights, window, min(threshold, most / 2))
    kept = [found[i].text for a, b in parts for i in range(a, b) if not found[i].apart and (marked is None or marked in found[i].within)]
    return " ".join(kept), parts


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", window: int = 3, threshold: int = 86) -> DataFrame:
    """key, url, text, n_chars (code points) and spans (stretches of lines) of each page. Null pages give an empty text."""
    ship(pages.sparkSession)
    key_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (key, url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [main_text(x.as_py(), window, threshold) for x in part.column(2)]
                texts = [t for t, _ in found]
                spans = [[{"first": a, "after": b} for a, b in s] for _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))],
                    [key, url, "text", "n_chars", "spans"],
                )

    schema = f"`{key}` {key_kind}, `{url}` {url_kind}, text string, n_chars long, spans array<struct<first: long, after: long>>"
    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(run, schema)
