"""Main text of web pages by line-block distribution.

Markup is stripped into lines: each block of running text is one line, and each element that holds no article text
(menus, forms, scripts and the like) leaves a gap of empty lines. The text lengths over a sliding window of lines make a
distribution; it surges where a window of enough text begins and dives where windows become empty. Text between the
first surge and the last dive is kept. A part that the page marks as article or main is evidence: where it holds as much
text as the largest surge outside, its edges are the surge and the dive, so that its short lines are not lost.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters of text at which a window counts as a surge.
WINDOW, SURGE = 3, 86
#: A stretch with a greater share of its characters in links is a list of links.
LINKS = 0.5

# Kinds of elements, as HTML has them.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title xmp iframe noembed noframes".split())
_BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_DROP = set("nav footer aside form button select input dialog menu svg canvas object audio video map math head fieldset search".split())
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark parts beside the article.
_BESIDE = set(
    "ad ads adslot advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion nav navbar navigation menu submenu header masthead topbar footer sidebar aside rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs widget widgets toolbar pagination pager form search copyright".split()
)
#: Words that tell an article's heading from the page's, that negate or only mention, and that mark an article as another one's.
_OWN, _ABOUT = set("article entry post story content".split()), set("has with without no".split())
_OTHERS = set("comment comments reply advert advertisement sponsored related recommended promo".split())
#: Elements that part a page; what else is left out, such as an advert between two paragraphs, is a gap of one line.
_APART = set("article main nav header footer aside".split())
_CLOSES_P = _BLOCK - {"br", "button", "select", "option", "optgroup", "body", "html", "head"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _beside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds something else than article text."""
    if tag in _DROP or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        wanted = tag == "article"
    else:
        wanted = True
    if not wanted or not attributes.strip():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id"):
            found = {w.lower() for w in _WORD.findall(value)}
            beside = found & _BESIDE
            if beside == {"header"} and found & _OWN or found & _ABOUT:
                continue  # the article's own heading; a word about another part, as in has-sidebar
            if beside and (tag != "article" or beside & _OTHERS):
                return True
    return False


def lines(page: str) -> list[tuple[str, int, int]]:
    """Lines of a page as (text, characters in links, number of the outermost article or main part or 0); a gap is an empty line."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it drops what it holds, whether it is a part's edge
    # Places in the stack of each tag, of block elements, and of elements that drop or are an edge: an end tag looks up its start.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    marks: list[int] = []
    piece: list[str] = []
    drop = part = parts = link = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(piece).split())
        if text:
            out.append((text, min(linked, len(text)), parts if part else 0))
        piece.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if not drop:
            text = html.unescape(raw) if "&" in raw else raw
            piece.append(text)
            if link:
                linked += len(text)

    def pop(to: int) -> None:
        nonlocal drop, part, link
        while len(stack) > to:
            tag, dropped, edge = stack.pop()
            places[tag].pop()
            if dropped or edge:
                marks.pop()
            if tag in _BLOCK:
                blocks.pop()
                flush()
            drop -= dropped
            if dropped and not drop or edge:
                out.extend([("", 0, parts if part else 0)] * (WINDOW if tag in _APART else 1))
            part -= edge
            link -= tag == "a"

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            open_ = places.get(tag)
            if open_ and (tag in _BLOCK or not marks or marks[-1] <= open_[-1]):
                pop(open_[-1])
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in _BLOCK and not drop:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            ends = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}.get(tag, ("p",))
            if blocks and (not marks or marks[-1] <= blocks[-1]) and stack[blocks[-1]][0] in ends:
                pop(blocks[-1])
        if m[3].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        dropped = bool(drop) or _beside(tag, m[3], part > 0)
        edge = not dropped and tag in ("article", "main")
        if dropped and not drop or edge:
            flush()
            out.extend([("", 0, parts if part else 0)] * (WINDOW if tag in _APART else 1))
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            blocks.append(len(stack))
        if dropped or edge:
            marks.append(len(stack))
        stack.append((tag, dropped, edge))
        drop += dropped
        parts += edge and not part
        part += edge
        link += tag == "a"
    pop(0)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty if there is none."""
    if not page:
        return ""
    found = lines(page)
    size = [len(text) for text, _, _ in found]
    total = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    hills: list[tuple[int, int]] = []
    i = 0
    while i < len(size):
        if size[i]:
            j = i
            while j < len(size) and (size[j] or any(size[j : j + WINDOW])):
                j += 1
            hills.append((i, j))
            i = j
        else:
            i += 1
    # A part's edges are gaps as wide as a window, so each hill is inside one marked part or outside of all.
    marked: dict[int, int] = {}
    for text, _, number in found:
        if number and text:
            marked[number] = marked.get(number, 0) + len(text)
    prose = [(a, b) for a, b in hills if sum(x[1] for x in found[a:b]) <= LINKS * sum(size[a:b])]
    high = [(a, b) for a, b in prose if max(total[a:b]) >= SURGE]
    if marked and max(marked.values()) >= max((sum(size[a:b]) for a, b in high if not found[a][2]), default=0):
        return " ".join(text for text, _, number in found if number and text)
    high = high or sorted(prose, key=lambda h: sum(size[h[0] : h[1]]))[-1:]
    if not high:
        return ""
    surge, dive = high[0][0], high[-1][1]
    return " ".join(x[0] for a, b in prose if surge <= a < dive for x in found[a:b] if x[0])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points). No shuffle; each page is read whole.

    A null or empty page, or one without article text, gives an empty text. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by one space. Null ids and urls, repeated rows and an
    empty table pass through; other columns are ignored.
    """
    src = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    kind = dict(src.dtypes)
    out = src.mapInArrow(_extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id, "url": url})
