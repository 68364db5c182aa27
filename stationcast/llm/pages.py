"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's streaming parser turns a page into lines: the text between two
block-level tags, with the number of tags around it, its share of link text and where it
stands. Text in parts that never are content (scripts, styles, menus, page headers and
footers, side columns, notices, adverts, forms, reader comments; by element, role, or
words of class and id) has no line. The text-to-tag ratios of the lines are smoothed
with a Gaussian; lines above a share of the page's mean ratio are content, and
neighbouring content lines form clusters. If the page marks its article (``article``,
``main``), the regions chosen are the marked ones that hold a cluster, whole; otherwise
they are the clusters near the weight of the heaviest, each with a heading above it.
Lines of links before the first and after the last content line of a region go.

Null and empty pages, and pages without text, give the empty string. Broken markup is
read as far as it goes: a missing end tag ends with its parent, a stray one is ignored.
Words of class and id, and forms, hide an element only while it holds no ``main``, no article
of a page without another one, and less text than the rest of the page and twice what was
chosen; otherwise the page is read again with that element open. Adverts, cookie notices and
newsletters are not opened for their length. Words with has-, no- or
with- before them and words on headings hide nothing; inside an article a name must consist
of such words. If nothing is left, neither words nor forms hide anything. Whole pages are read.
Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stationcast.llm.common import annotate

#: Elements that end a line (fixed values: block-level and table elements).
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup"
    " option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements that never hold the main text.
SKIPPED = frozenset(
    "script style noscript template head title nav footer aside iframe object svg math canvas audio video"
    " button select textarea dialog menu datalist".split()
)
#: ARIA roles that never hold the main text.
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id that mark other parts of a page.
SKIPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead ad ads adv advert adverts"
    " advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice"
    " notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " related recommended recommendations comment comments commentlist disqus reply replies respond search searchbox"
    " pagination pager widget toolbar copyright skip".split()
)
#: Of these, words of parts that often hold articles of their own, and of those that may be longer than the main text.
CARD_WORDS = frozenset("related recommended recommendations sidebar promo promotion sponsor sponsored widget".split())
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: A part with one of these words opens only if it holds the page's article, however long it is.
ADVERT_WORDS = frozenset(
    "ad ads adsense adv advert adverts advertisement advertising consent cookie cookies gdpr newsletter promo promotion sponsor"
    " sponsored subscribe subscription".split()
)
#: Words that are content inside an article, and words that add nothing to a name there.
ARTICLE_WORDS = frozenset("header notice notification alert".split())
PLAIN_WORDS = frozenset(
    "area articles bar block box btn button buttons container content footer form group holder icon icons inline inner item items"
    " left link links list news outer panel post posts right row section site stories top bottom widget wrap wrapper".split()
)
PREFIXES = frozenset("has no not with without".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An end tag of another element doesn't close these.
WALLS = frozenset(("article", "main", "table", "td", "th", "body", "html"))
SIGMA = 1.0
THRESHOLD = 0.3
GAP = 2
NEAR_HEAVIEST = 0.25
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LINKY = 0.8
#: Inline elements looked through for the paragraph that a block ends.
DEEP = 64
#: Readings of a page that open one hidden part each.
READINGS = 8
OPEN, CLOSED, HIDDEN = range(3)


@dataclass
class Line:
    text: str
    tags: int
    links: float
    region: int | None
    heading: bool


@dataclass
class Part:
    """An element hidden by a word or as a form: its place among the start tags, its words and what it holds."""

    place: int
    words: set[str]
    chars: int = 0
    main: bool = False
    article: bool = False


class Lines(HTMLParser):
    """Collects the lines of a page and the hidden parts; those whose place is in ``shown`` are not hidden."""

    def __init__(self, use_words: bool = True, shown: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.use_words, self.shown = use_words, shown
        self.stack: list[tuple[str, int, int | None]] = []  # element, OPEN, CLOSED or HIDDEN, region
        self.parts: list[Part] = []
        self.place = 0
        self.found: list[Line] = []
        self.text: list[str] = []
        self.open: Counter = Counter()
        self.tags = self.link_chars = self.chars = self.in_link = self.regions = 0

    def skips(self, tag: str, attrs: list[tuple[str, str | None]], region: int | None) -> bool:
        if tag in SKIPPED:
            return True
        if tag in ("html", "body") or tag in ARTICLE and region is None:
            return False
        named = dict(attrs)
        if tag == "header" and region is None or "hidden" in named or (named.get("role") or "").lower() in SKIPPED_ROLES:
            return True
        return False

    def hiding(self, tag: str, attrs: list[tuple[str, str | None]], region: int | None) -> set[str]:
        """The words that hide an element (of a form also its name)."""
        if not self.use_words or tag in ("html", "body", *HEADINGS) or tag in ARTICLE and region is None:
            return set()
        named = dict(attrs)
        found = {"form"} if tag == "form" else set()
        for name in f"{named.get('class') or ''} {named.get('id') or ''}".split():
            words = [w.lower() for w in WORD.findall(name)]
            if not words or words[0] in PREFIXES:
                continue
            own = SKIPPED_WORDS.intersection(words)
            if region is not None:
                own -= ARTICLE_WORDS
                if tag == "p" or not all(w in own or w in PLAIN_WORDS for w in words):
                    continue
            found |= own
        return found

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tag, _, region = self.stack[-1] if self.stack else ("", OPEN, None)
            heading = any(t in HEADINGS for t, _, _ in self.stack[-4:])
            self.found.append(Line(text, max(self.tags, 1), self.link_chars / max(self.chars, 1), region, heading))
            self.tags = 0
        self.text, self.link_chars, self.chars = [], 0, 0

    def pop_to(self, depth: int) -> None:
        for tag, _, _ in self.stack[depth:]:
            self.open[tag] -= 1
            self.in_link -= tag == "a"
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.place += 1
        if tag in BLOCKS:
            self.flush()
            if tag not in VOID:
                depth = len(self.stack)
                while depth and len(self.stack) - depth < DEEP and self.stack[depth - 1][0] not in BLOCKS:
                    depth -= 1
                if depth and self.stack[depth - 1][0] in ("p", *HEADINGS):  # ended by the next block
                    self.pop_to(depth - 1)
                elif depth and tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack[depth - 1][0] == tag:
                    self.pop_to(depth - 1)
        if tag in VOID:
            return
        if tag in ARTICLE:  # an article inside an unclosed menu is one all the same
            at = next((i for i, (t, skipped, _) in enumerate(self.stack) if skipped and t in ("nav", "head", "title")), None)
            if at is not None:
                self.pop_to(at)
        skipped, region = self.stack[-1][1:] if self.stack else (OPEN, None)
        if skipped != CLOSED and self.skips(tag, attrs, region):
            skipped = CLOSED
        elif skipped == HIDDEN:
            self.parts[-1].main |= tag == "main"
            self.parts[-1].article |= tag == "article"
        elif skipped == OPEN:
            words = self.hiding(tag, attrs, region)
            if words and self.place not in self.shown:
                skipped = HIDDEN
                self.parts.append(Part(self.place, words))
            elif tag in ARTICLE and region is None:
                region = self.regions
                self.regions += 1
        self.in_link += tag == "a"
        self.open[tag] += 1
        self.stack.append((tag, skipped, region))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash has no meaning on other elements
        if tag not in VOID and self.stack and tag not in BLOCKS and tag not in SKIPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if self.stack[i][0] in WALLS and tag not in WALLS:
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][1]:
            if self.stack[-1][1] == HIDDEN and not self.in_link:
                self.parts[-1].chars += len("".join(data.split()))
            return
        self.text.append(data)
        n = len(data) - data.count(" ")
        self.chars += n
        if self.in_link:
            self.link_chars += n


def read(html: str, use_words: bool = True, shown: frozenset[int] = frozenset()) -> Lines:
    parser = Lines(use_words, shown)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def plain_chars(lines: list[Line]) -> float:
    """Characters outside links, without spaces."""
    return sum(len(x.text.replace(" ", "")) * (1 - x.links) for x in lines)


def wrongly_hidden(page: Lines, chosen: list[Line]) -> set[int]:
    """Places of the hidden parts that hold the page's article or most of its text."""
    if not page.parts:
        return set()
    kept, total = plain_chars(chosen), plain_chars(page.found) + sum(p.chars for p in page.parts)
    marked = any(x.region is not None for x in page.found)
    return {
        p.place
        for p in page.parts
        if p.main
        or p.article and not marked and not p.words & (CARD_WORDS | READER_WORDS)
        or not p.words & (READER_WORDS | ADVERT_WORDS) and (p.chars > total / 2 or p.chars > 2 * kept)
    }


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that fall inside count in full."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    weights = np.exp(-(reach**2) / (2 * sigma**2))
    wide = len(ratios) + 2 * int(3 * sigma)
    part = slice((wide - len(ratios)) // 2, (wide + len(ratios)) // 2)
    return np.convolve(ratios, weights)[part] / np.convolve(np.ones(len(ratios)), weights)[part]


def clusters(content: np.ndarray) -> list[tuple[int, int]]:
    """Runs of content lines (first, last) with at most ``GAP`` other lines between neighbours."""
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(content).tolist():
        if out and i - out[-1][1] <= GAP + 1:
            out[-1] = out[-1][0], i
        else:
            out.append((i, i))
    return out


def choose(lines: list[Line]) -> list[Line]:
    """The lines of the content regions."""
    if not lines:
        return []
    ratios = np.array([len(x.text) * (1 - x.links) / x.tags for x in lines])
    smooth = smoothed(ratios)
    content = smooth >= THRESHOLD * smooth.mean()
    content &= np.array([x.links < LINKY for x in lines])
    found = clusters(content)
    if any(x.region is not None for x in lines):
        held = {lines[i].region for a, b in found for i in range(a, b + 1) if content[i]} - {None}
        held = held or {x.region for x in lines} - {None}
        by_region = defaultdict(list)
        for i, x in enumerate(lines):
            by_region[x.region].append(i)
        spans = [by_region[r] for r in sorted(held)]
    else:
        weight = [sum(len(lines[i].text) for i in range(a, b + 1)) for a, b in found]
        spans = []
        for (a, b), w in zip(found, weight, strict=True):
            if w >= NEAR_HEAVIEST * max(weight):
                while a and lines[a - 1].heading:
                    a -= 1
                spans.append(list(range(a, b + 1)))
        if not spans:
            return []
    chosen = []
    for span in spans:
        core = [i for i in span if content[i]] or span
        chosen += [i for i in span if core[0] <= i <= core[-1] or lines[i].links < LINKY]
    return [lines[i] for i in sorted(set(chosen))]


def main_text(html: str) -> str:
    """The main text of a page."""
    shown: frozenset[int] = frozenset()
    for _ in range(READINGS):
        page = read(html, shown=shown)
        chosen = choose(page.found)
        wrong = wrongly_hidden(page, chosen)
        if not wrong:
            break
        shown |= wrong
    else:
        chosen = []
    chosen = chosen or choose(read(html, use_words=False).found)
    return " ".join(x.text for x in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id, ``text`` and ``n_chars`` (its code points). No shuffle."""

    def run(texts: pa.Array) -> dict:
        found = [main_text(t) for t in texts.to_pylist()]
        return {"text": found, "n_chars": [len(t) for t in found]}

    return annotate(pages, run, pa.schema([("text", pa.string()), ("n_chars", pa.int64())]), id_col, html_col)
