"""Operator 9: main text of HTML pages by the line-block distribution.

1. Markup is stripped into lines (attributes are read by whole names: ``no-sidebar`` and ``share-price`` aren't boilerplate): block elements end a line; scripts, styles, comments,
   templates and the like vanish.  List items, table cells, rows, options and paragraphs without an end tag
   end where HTML ends them.  Lines inside navigation, headers, footers, sidebars,
   forms, adverts, notices and reader comments (by element, role, class or id) count 0
   characters, as do all lines outside of an ``article`` or ``main`` on a page that has one.
2. On a page with ``article`` or ``main`` every counted line is kept: these elements decide, not the blocks, unless
   the article's text is shorter than ``surge`` and a block outside of it isn't.
3. On all other pages the lines that count 0 are left out, and the block at line i sums the
   characters of ``window`` lines from i on; lines that are mostly links, and copyright lines, have 0 in it.
4. The text surges at a line with text whose block is ``surge`` long, and dives where the blocks fall to 0.
   Where no block is that long (short pages), it surges at every line with text.
5. From both ends of such a run, short lines are taken off that are neither paragraphs, headings nor
   sentences, nor stand in an element with a long line: menu, footer and teaser entries that a window reaches.
   A list at the end stays if it's in the same box as a long line.  Runs with at least ``share`` of the longest run's characters are kept.
6. Before the first run, the title (the nearest heading, and those of higher level before it) is kept, and
   what stands between it and the run, but for links and list entries.

Nulls: null html, and a page without text, give an empty text.  Whole pages of any length
are read; broken markup (open tags at the end, stray ends) never fails.  Each row is decided by itself, so ties,
repeated rows and empty tables need no rule.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import make_room, pick

# Element names of HTML, by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced msub msup "
    "msubsup munder mover munderover mspace mtable mtr mtd semantics annotation".split()
)
RAW = frozenset("script style textarea iframe title head".split())
UNSEEN = frozenset("noscript template svg object canvas select datalist optgroup option".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu button".split()) | UNSEEN
HARD = BOILERPLATE - {"form"}
CONTENT = frozenset("article main".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements whose end tag may be missing: what ends them, and the elements that the search for them doesn't leave.
_LAYOUT = frozenset(
    "article aside blockquote body button center details dir dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html main menu nav "
    "object ol pre section select table tbody td template tfoot th thead tr ul".split()
)
_TABLE = frozenset("table template".split())
_IMPLIED = [
    ("p", _BLOCKS | frozenset("li dd dt center details dir figcaption figure hgroup menu summary".split()), frozenset("button object table td th template caption".split())),
    ("li", frozenset(["li"]), _LAYOUT),
    ("dt dd", frozenset("dt dd".split()), _LAYOUT),
    ("svg math option optgroup", _BLOCKS, frozenset(["foreignobject"])),
    ("option", frozenset("option optgroup".split()), frozenset("select datalist optgroup".split())),
    ("optgroup", frozenset(["optgroup"]), frozenset("select datalist".split())),
    ("td th", frozenset("td th tr tbody thead tfoot".split()), _TABLE | {"tr"}),
    ("tr", frozenset("tr tbody thead tfoot".split()), _TABLE | frozenset("tbody thead tfoot".split())),
    ("tbody thead tfoot", frozenset("tbody thead tfoot".split()), _TABLE),
]
#: By start tag: (elements that it ends, where the search for them stops), the innermost first.
CLOSED_BY: dict[str, list[tuple[frozenset[str], frozenset[str]]]] = {}
for _ended, _by, _stop in _IMPLIED:
    for _name in _by:
        CLOSED_BY.setdefault(_name, []).append((frozenset(_ended.split()), _stop))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
# Words of class and id attributes of boilerplate.
WORDS = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice popup modal newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies "
    "reply widget toolbar pagination pager".split()
)

# Words beside these in a compound name (``share-buttons``, but not ``share-price``), and those that only tell of a layout (``no-sidebar``).
COMPANIONS = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons card cell center column container content cta entry fixed foot form forms global group head "
    "heading icon icons inner item items label left link links list main mobile module outer page panel placeholder post posts primary region right row secondary "
    "section site slot space sticky stories story sub tag teaser text title toggle tools top unit user view web wide wrap wrapper".split()
)
LAYOUTS = frozenset("no non not without has have with hide hidden".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_QUOTED_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
_STOPS = re.compile("[>\"']")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u061f\u0964][\"'\u201d\u2019\u00bb)\]]*\Z")
_COPYRIGHT = re.compile(r"\u00a9|\bcopyright\s+(?:\(c\)|\d{4})", re.I)
# Elements whose text is prose however short, and headings by level.
PROSE = frozenset("p blockquote pre dd figcaption".split())
LEVEL = {f"h{k}": k for k in range(1, 7)}
LISTS = frozenset("li dt dd td th".split())
BOXES = frozenset("div section td center".split())


def _telling(word: str) -> bool:
    """Whether a word is boilerplate's, alone or run together with one that stands beside such words (``commentlist``)."""
    if word in WORDS:
        return True
    halves = ((word[:k], word[k:]) for k in range(3, len(word) - 2))
    return any(a in WORDS and len(a) > 5 and b in COMPANIONS or b in WORDS and len(b) > 5 and a in COMPANIONS for a, b in halves)


def named(value: str, inside: bool) -> bool:
    """Whether one of the names of a class or id attribute is boilerplate's."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        hits = [_telling(w) and not (inside and w == "header") for w in words]
        if not any(hits) or words[0] in LAYOUTS:
            continue
        if all(hit or w in COMPANIONS or len(w) < 3 for w, hit in zip(words, hits)) or hits[-1] and not inside:
            return True
    return False


def boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is menu, header, footer, advert, notice, form or comments.

    A header inside the article is the article's own.
    """
    if name == "header":
        return not inside
    if name in BOILERPLATE:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in _NAMED.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and name not in INLINE and named(value, inside):
            return True
    return False


class Tags:
    """The tags of a page, each place of which is looked at a fixed number of times, whatever the markup.

    A tag ends at the first ``>`` outside of quotes.  Where none is, the opening quotes that were passed lead nowhere,
    from wherever they're reached; they are remembered, so no other tag follows them again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last_open, self.last_close = page.rfind("<"), page.rfind(">")
        self.nowhere: set[int] = set()
        self.stops: list[int] | None = None

    def _leads_on(self, at: int) -> bool:
        """Whether a tag whose name ends at a place has an end; after the first that has none."""
        if self.stops is None:
            self.stops = [m.start() for m in _STOPS.finditer(self.page)]
        passed = []
        while (k := bisect.bisect_left(self.stops, at)) < len(self.stops):
            stop = self.stops[k]
            if self.page[stop] == ">":
                return True
            if stop in self.nowhere:
                break
            passed.append(stop)
            if (close := self.page.find(self.page[stop], stop + 1)) < 0:
                break
            at = close + 1
        self.nowhere.update(passed)
        return False

    def _tag(self, at: int) -> re.Match | None:
        for pattern in (_TAG, _QUOTED_NAME):  # a name that holds a quote may have to end before it
            if self.nowhere:
                end = _NAME.match(self.page, at)
                if end and not self._leads_on(end.end() if pattern is _TAG else min((k for q in "\"'" if (k := self.page.find(q, at, end.end())) >= 0), default=end.end())):
                    continue
            if m := pattern.match(self.page, at):
                return m
            if end := _NAME.match(self.page, at):
                self._leads_on(end.end())
        return None

    def after(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """(start, end, match of a tag or None for what is skipped) of the next piece of markup."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), None
            sign = page[at + 1 : at + 2]
            if sign and (sign in "!?/" or sign.isascii() and sign.isalpha()):
                if sign in "!?":
                    if self.last_close > at:
                        return at, page.find(">", at) + 1, None
                elif self.last_close > at and (m := self._tag(at)):
                    return at, m.end(), m
                if at == self.last_open:  # cut off at the end of the page
                    return at, len(page), None
            at += 1
        return None


class Line(NamedTuple):
    text: str
    size: int  # counted characters
    waste: int  # boilerplate elements around it
    forms: int  # those of them that are forms
    inside: bool  # an article is around it
    around: int  # boilerplate elements around that article, -1 if not only forms and classes
    links: int  # characters in links
    kind: str  # the block element around it
    box: int  # the nearest open box, 0 for none


def lines(page: str) -> tuple[list[Line], bool]:
    """The lines of a page; whether it has an article that decides.

    An article that only forms and class names make boilerplate counts where the page has no other; and
    where nothing else is left, what forms alone make boilerplate counts.
    """
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, boilerplate here, article here, link, box around
    around: list[int] = []  # of each open article
    forms = hard = 0
    held: dict[str, list[int]] = {}  # where elements of a name stand on the stack
    blocks: list[str] = []  # the open elements that aren't inline
    link_at = -1
    tags = Tags(page)
    unclosed: set[str] = set()
    last: dict[str, int] = {}  # where the last end tag of an unseen element stands
    waste = inside = linked = box = boxes = 0
    link_chars = 0

    def end() -> None:
        nonlocal link_chars
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                kind = blocks[-1] if blocks else ""
                out.append(Line(text, 0 if waste else len(text), waste, forms, inside > 0, around[0] if around else -1, min(link_chars, len(text)), kind, box))
        link_chars = 0

    def leave(n: int) -> None:
        nonlocal waste, inside, linked, box, forms, hard
        while len(stack) > n:
            name, w, c, l, box = stack.pop()
            forms -= w and name == "form"
            hard -= w and name in HARD
            if c:
                around.pop()
            held[name].pop()
            if not held[name]:
                del held[name]
            if name not in INLINE:
                blocks.pop()
            waste -= w
            inside -= c
            linked -= l

    at = 0
    while True:
        found = tags.after(at)
        text = page[at : found[0] if found else len(page)]
        if text:
            parts.append(text)
            if linked:
                link_chars += len(_SPACE.sub(" ", entities.unescape(text)))
        if not found:
            break
        at, m = found[1:]
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = held[name][-1] if name in held else None
            if name not in INLINE:
                end()
            if k is not None:
                leave(k)
            continue
        if name in RAW:
            if name not in INLINE:
                end()
            if not m[3].rstrip().endswith("/"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                if close and (end_at := page.find(">", close.end())) >= 0:
                    at = end_at + 1
                    continue
                unclosed.add(name)
                if name in ("script", "style"):  # what follows is code
                    at = len(page)
                elif name != "head":  # its text goes up to the next tag
                    at = k if (k := page.find("<", at)) >= 0 else len(page)
            continue
        if name not in INLINE:
            end()
        for ended, stop in CLOSED_BY.get(name, ()):
            k = max((held[x][-1] for x in ended if x in held), default=-1)
            if k >= 0 and not any(x in held and held[x][-1] > k for x in stop):
                leave(k)
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name in UNSEEN and name not in ("option", "optgroup"):
            if name not in last:
                last[name] = max((x.start() for x in re.finditer(rf"</{name}\b", page, re.I)), default=-1)
            if last[name] < at:  # never ended: the tag alone is skipped
                continue
        w, c = boilerplate(name, m[3], inside > 0), name in CONTENT
        if c:
            around.append(-1 if hard else waste)
        link = name == "a" and "href" in m[3].lower()
        if name == "a" and linked:  # a link ends the one before
            stack[link_at] = (*stack[link_at][:3], False, stack[link_at][4])
            linked -= 1
        if link:
            link_at = len(stack)
        held.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(name)
        stack.append((name, w, c, link, box))
        waste += w
        forms += w and name == "form"
        hard += w and name in HARD
        inside += c
        linked += link
        if name in BOXES:
            boxes += 1
            box = boxes
    end()
    if any(x.inside and x.size for x in out):
        return [x if x.inside else x._replace(size=0) for x in out], True
    held_back = [x.inside and x.around > 0 and x.waste == x.around for x in out]
    if any(held_back):
        return [x._replace(size=len(x.text) if good else 0) for x, good in zip(out, held_back)], True
    if not any(x.size for x in out):
        out = [x._replace(size=len(x.text) if x.waste == x.forms else 0) for x in out]
    return out, False


def line_blocks(found: list[Line], window: int, surge: int, share: float) -> list[str]:
    """The texts kept of a page that has neither article nor main, by surge and dive."""
    found = [x for x in found if x.size]
    sizes = [0 if 2 * x.links > x.size or x.size < 200 and _COPYRIGHT.search(x.text) else x.size - x.links for x in found]
    if not any(sizes):
        sizes = [x.size for x in found]
    sums = list(itertools.accumulate(sizes, initial=0))
    blocks = [sums[min(i + window, len(sizes))] - sums[i] for i in range(len(sizes))]
    least = surge if max(blocks, default=0) >= surge else 1
    firm = [n > 0 and (n >= surge or x.kind in PROSE or x.kind in LEVEL or _SENTENCE.search(x.text) is not None) for x, n in zip(found, sizes)]

    def heads(k: int) -> bool:
        """Whether text and not a menu follows a heading."""
        return found[k].kind == "h1" or k + 1 < len(sizes) and sizes[k + 1] > 0

    def trimmed(a: int, b: int) -> tuple[int, int]:
        at, to = a, b
        long = [found[k] for k in range(a, b) if sizes[k] >= surge]
        boxes, direct = {x.box for x in long} - {0}, {(x.kind, x.box) for x in long if x.kind not in LISTS}
        beside = lambda k: sizes[k] and (found[k].kind, found[k].box) in direct
        while at < to and not (beside(at) or firm[at] and (found[at].kind not in LEVEL or heads(at))):
            at += 1
        while at < to and (found[to - 1].kind in LEVEL or not (firm[to - 1] or beside(to - 1) or sizes[to - 1] and found[to - 1].kind in LISTS and found[to - 1].box in boxes)):
            to -= 1
        return (at, to) if at < to else (a, b)

    runs: list[tuple[int, int]] = []
    i = 0
    while i < len(sizes):
        if sizes[i] and blocks[i] >= least:
            start = i
            while i < len(sizes) and blocks[i]:
                i += 1
            runs.append(trimmed(start, i))
        else:
            i += 1
    if not runs:
        return []
    own = [sums[b] - sums[a] for a, b in runs]
    runs = [r for r, n in zip(runs, own) if n >= share * max(own)]
    first = runs[0][0]
    title, level = first, LEVEL.get(found[first].kind, 7)
    for k in range(first - 1, -1, -1):
        here = LEVEL.get(found[k].kind, 7)
        if here < level and sizes[k] and heads(k):
            title, level = k, here
    lead = [k for k in range(title, first) if sizes[k] and (heads(k) if found[k].kind in LEVEL else firm[k] or found[k].kind not in LISTS)]
    return [found[k].text for k in [*lead, *(k for a, b in runs for k in range(a, b))]]


def main_text(page: str | None, window: int = 3, surge: int = 86, share: float = 0.2) -> str:
    found, has = lines(page or "")
    if has and sum(x.size for x in found) < surge:  # too short for a surge: a longer text beside it decides
        every = [x._replace(size=0 if x.waste else len(x.text)) for x in found]
        has = max(sum(x.size for x in every[i : i + window] if not x.inside) for i in range(len(every))) < surge
        found = found if has else every
    return " ".join([x.text for x in found if x.size] if has else line_blocks(found, window, surge, share))


def extract_text(pages: DataFrame, window: int = 3, surge: int = 86, share: float = 0.2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("html")
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [main_text(p, window, surge, share) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
