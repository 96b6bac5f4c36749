"""Main-text extraction from HTML by line-block distribution.

Markup is stripped to lines, one per block element.  Each line has a weight, the
length of its text adjusted by what the markup says:

* in a marked article or main part every line has its whole length and ``MARK``
  more; on a page with such a part, other lines have ``ASIDE`` of theirs;
* on a page without, text in paragraphs and headings has its length and ``TEXT``
  more, other text ``PLAIN`` of its length, and lines that are mostly links none;
* what is never article text (menus, page headers and footers, sidebars, forms,
  notices, adverts, reader comments) weighs less than nothing.  Elements say so,
  and class names, ids and roles where every part of the name does:
  ``sidebar`` and ``comment-list``, but not ``with-sidebar``.

Weights are summed over a sliding window of lines.  Text starts where the sum
surges, at the first line of that window that has a good part of it, and ends
where the sum dives under half of that; the lines between that weigh anything
are the article.

Defined results: null or empty html, or a page without such lines, gives the
empty string; end tags may be missing (a paragraph or list item ends with the
next, anything else with the element around it, ``_strip`` says where elements
without text do); an article begins also inside an unclosed menu; texts of any
length are taken whole; repeated rows are treated alike; an empty table gives an
empty table; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_batch

WINDOW = 3
#: Weight of a window that begins a text, or half of the heaviest one's, if that is less.
SURGE = 120.0
MARK, TEXT, PLAIN, ASIDE = 60.0, 60.0, 0.3, 0.1

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)(noscript|template|svg|head|iframe|select|textarea|button|body|article|main)\b([^>]*)>", re.S | re.I)
_META = re.compile(r"(?:\s+|<!--.*?-->|<(?:base|basefont|bgsound|link|meta)\b[^>]*>|<(title|script|style|noscript|template)\b[^>]*>.*?</\1\s*>)*", re.S | re.I)
# a tag holds no other "<" outside quotes, so that a page of unclosed ones is read in linear time
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^<>]*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[\s_\-]+")

# Element names and the words of class names.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog".split())
_MAIN = frozenset("article main".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
_AGAIN = frozenset("p li dt dd tr td th option".split())
_BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies dialog footer menu menubar modal nav navbar navigation newsletter notice notices popup promo related search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_NEUTRAL = frozenset("area bar block body bottom box buttons col column container content group header inner item items left links list main page panel posts primary reader right secondary section site slot thread top wrap wrapper".split())


def _strip(html: str) -> str:
    """The page without comments and the elements whose content is no text.

    Without its end tag such an element ends before the next body, article or
    main, a head before what no head holds, any other at its own start tag; only
    comments, scripts and styles run to the end of the page.
    """
    ends: dict[int, int] = {}
    landmarks: list[int] = []
    open_: dict[str, list[int]] = {}
    cuts: list[tuple[int, int, str]] = []
    for m in _RAW.finditer(html):
        name = (m[3] or "").lower()
        if not name:
            cuts.append((*m.span(), ""))
        elif name in ("body", "article", "main"):
            if not m[2]:
                landmarks.append(m.start())
        elif m[2]:
            if open_.get(name):
                ends[open_[name].pop()] = m.end()
            cuts.append((*m.span(), ""))
        else:
            if not m[4].endswith("/"):
                open_.setdefault(name, []).append(m.start())
            cuts.append((*m.span(), name))
    unclosed = {start for starts in open_.values() for start in starts}
    out, at = [], 0
    for start, end, name in cuts:
        if start < at:
            continue
        out += [html[at:start], " "]
        at = ends.get(start, end)
        if start in unclosed:
            i = bisect_left(landmarks, start)
            if name == "head":
                at = _META.match(html, end).end()
            elif i < len(landmarks):
                at = landmarks[i]
    return "".join([*out, html[at:]])


def _boilerplate(attributes: str) -> bool:
    """Whether a class, id or role is named for boilerplate by all parts of its name."""
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w.rstrip("0123456789") for w in _SPLIT.split(name)]
            if not _BOILERPLATE.isdisjoint(words) and all(not w or w in _BOILERPLATE or w in _NEUTRAL for w in words):
                return True
    return False


@dataclass
class Line:
    """A block's text, the characters of it outside links, what holds it (1 a marked article, -1 boilerplate, 0 neither), and whether it is a paragraph or heading."""

    text: str
    plain: int
    within: int
    prose: bool


def lines(html: str) -> list[Line]:
    """The page's blocks in order."""
    html = _strip(html)
    out: list[Line] = []
    parts: list[str] = []
    #: open elements: name, what holds their text, and whether a marked article is around
    open_: list[tuple[str, int, bool]] = []
    depth: Counter[str] = Counter()
    link, plain, prose = 0, 0, False

    def end() -> None:
        nonlocal parts, plain
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Line(text, plain, open_[-1][1] if open_ else 0, prose))
            parts, plain = [], 0

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            plain += 0 if link else len(piece.strip())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link = max(0, link + (-1 if closing else 1))
        if name in _INLINE or name == "br":
            continue
        end()
        link, prose = 0, not closing and name in _PROSE
        if name in _VOID or name in ("html", "body"):
            continue
        if closing:
            i = len(open_) - 1 if depth[name] else -1
            while i >= 0 and open_[i][0] != name and (name not in _AGAIN or open_[i][0] in _AGAIN):
                i -= 1
            if i >= 0 and open_[i][0] == name:
                depth.subtract(n for n, _, _ in open_[i:])
                del open_[i:]
            continue
        if m[3].endswith("/"):
            continue
        while open_ and (open_[-1][0] == "p" or open_[-1][0] == name and name in _AGAIN):
            depth[open_.pop()[0]] -= 1
        _, within, marked = open_[-1] if open_ else ("", 0, False)
        if name in _MAIN and not (marked and within < 0):
            within, marked = 1, True
        elif name in _OUTSIDE or name == "header" and within < 1:
            within = -1
        if m[3] and _boilerplate(m[3]):
            within = -1
        open_.append((name, within, marked))
        depth[name] += 1
    if at < len(html):
        parts.append(html[at:])
        plain += 0 if link else len(html[at:].strip())
    end()
    return out


def weights(found: list[Line]) -> list[float]:
    marked = any(line.within > 0 for line in found)
    out = []
    for line in found:
        n = len(line.text)
        if line.within < 0:
            out.append(-float(n))
        elif line.within > 0:
            out.append(n + MARK)
        elif 2 * line.plain <= n:
            out.append(0.0)
        elif marked:
            out.append(ASIDE * line.plain)
        else:
            out.append(line.plain + TEXT if line.prose else PLAIN * line.plain)
    return out


def between(weight: list[float]) -> list[int]:
    """Numbers of the lines between surge and dive that weigh anything."""
    own = [max(0.0, w) for w in weight]
    total = [sum(own[i : i + WINDOW]) for i in range(len(own))]
    surge = min(SURGE, max(total, default=0.0) / 2)
    if not surge:
        return []
    keep, inside = [], False
    for i, n in enumerate(total):
        if not inside and n >= surge:
            # the surge lies at the first line that has a good part of the window, at most its last
            inside = 2 * own[i] >= surge or not any(2 * w >= surge for w in own[i : i + WINDOW])
        elif inside and 2 * n < surge:
            inside = False
        if inside and own[i]:
            keep.append(i)
    return keep


def extract(html: str | None) -> str:
    if not html:
        return ""
    found = lines(html)
    return " ".join(found[i].text for i in between(weights(found)))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, url, text, n_chars."""
    slim = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias(url), F.col(f"`{html}`").cast("string").alias(html))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in slim.schema]
    return per_batch(slim, step, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
