"""Main text of web pages by text-to-tag ratio over parser events.

The standard library's parser streams events; blocks (the "lines") end at block tags.
A block's ratio is its unlinked text over its tags. Evidence lowers it: each element around
the block that is page furniture by tag, class or id takes it down to a hundredth, relative
to the blocks with least evidence, so that a wrapper around everything says nothing. Ratios
are smoothed along the page with a Gaussian and clustered by a threshold on them; the region
of a selected block is its container, so that short paragraphs beside long ones stay. Lists,
tables and quotations in a region or between selected blocks belong to it, except blocks that
are mostly links. If the page names its article, regions lie within it. A form or fieldset
around the article or nearly all text is no evidence; its controls are never text.

Scripts, styles, controls and inline furniture inside a block do not split it. A comment or
tag that is still open where the page ends goes with what it holds, as in a browser.
A null or empty page, and one without content, gives an empty text. White space inside
a block becomes one space; blocks are joined by two line breaks in page order.
Repeated rows each give a row; an empty table gives none; work is linear in the page.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

# HTML elements by role in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header hgroup html main menu nav ol pre section table ul".split())
NESTED = frozenset("blockquote details dl figure ol pre table ul".split())  # part of what they stand in
NEVER = frozenset("button datalist dialog footer head iframe label menu nav noscript object option script select style svg template textarea title".split())
FORMS = frozenset("fieldset form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promoted recommended related replies reply respond share sharing sidebar signup sitemap skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_PARTS = re.compile(r"[a-z]+")
_STATE = re.compile(r"(?:has|have|is|no|not|with|without|show|hide)[-_]")  # says something about the page, not the element


def _named_furniture(value: str, whole: bool) -> bool:
    """Does a class or id name furniture? ``whole``: only if a name is such a word as it stands."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        if not _STATE.match(name) and (name in WORDS if whole else not WORDS.isdisjoint(_PARTS.findall(name))):
            return True
    return False


LIGHT, STRONG = 1, 2  # evidence by name, by tag


def _evidence(tag: str, attrs: list, in_article: bool) -> int:
    """0, LIGHT or STRONG evidence that an element is furniture; -1: it is never text."""
    if tag in ("html", "body", "main"):
        return 0
    if tag in NEVER:
        return -1
    found = STRONG if tag == "aside" or (tag == "header" and not in_article) else 0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return -1
        if value and name == "role" and value.strip().lower() in ROLES:
            return -1
        if value and name in ("class", "id") and not found and tag not in HEADINGS and _named_furniture(value, tag == "article"):
            found = LIGHT
    return found


class _Element:
    """An open element: what it says about the text in it, and the text set aside for it."""

    __slots__ = ("article", "container", "depth", "evidence", "forms", "never", "outer", "silent", "strong", "tag")

    def __init__(self, tag: str, around: _Element | None) -> None:
        self.tag, self.depth, self.outer = tag, 0, None
        self.evidence, self.forms, self.container = (around.evidence, around.forms, around.container) if around else (0, 0, 0)
        self.never, self.article, self.strong = (around.never, around.article, around.strong) if around else (False, False, False)
        self.silent = bool(around) and around.silent  # not even a line of the page


class Block:
    """A "line" of the page: its text, tags and linked characters, and what stands around it."""

    __slots__ = ("around", "linked", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, around: _Element) -> None:
        self.text, self.tags, self.linked, self.around = text, tags, linked, around

    @property
    def own(self) -> int:
        return 0 if self.around.never else max(0, len(self.text) - self.linked)


class Page(HTMLParser):
    """Collects the blocks of a page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack = [_Element("", None)]
        self.open: dict[str, int] = {}
        self.up: dict[int, tuple[int, bool]] = {0: (0, False)}  # container: the one around it, is it nested
        self.words: list[str] = []
        self.tags = self.linked = self.links = self.count = 0

    def _pop(self) -> None:
        gone = self.stack.pop()
        self.open[gone.tag] -= 1
        if gone.outer:  # inline furniture: the block around it goes on
            self.words, self.tags, self.linked = gone.outer

    def _end_block(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.blocks.append(Block(text, self.tags, self.linked, self.stack[-1]))
            self.words = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self._end_block()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.stack[-1].tag == tag:
                self._pop()
            while self.stack[-1].tag == "p":  # a block closes an open paragraph
                self._pop()
        elif tag == "br" and not self.stack[-1].silent:
            self.words.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        outer = self.stack[-1]
        evidence = _evidence(tag, attrs, outer.article)
        if not block and not evidence:
            if outer.tag == tag:
                outer.depth += 1  # its end tag is not the outer element's
            return
        inner = _Element(tag, outer)
        inner.never |= evidence < 0
        inner.silent |= evidence < 0 and not block
        inner.evidence += max(0, evidence)
        inner.strong |= evidence == STRONG
        inner.forms += tag in FORMS
        if tag == "main":
            inner.evidence, inner.strong = 0, False
        if tag in ("article", "main"):
            inner.article, inner.forms = True, 0
        if tag in CONTAINERS:
            self.count += 1
            self.up[self.count] = (outer.container, tag in NESTED or outer.tag in ("li", "dt", "dd", "td", "th", "figcaption"))
            inner.container = self.count
        if not block:
            inner.outer = (self.words, self.tags, self.linked)
            self.words, self.tags, self.linked = [], 0, 0
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(inner)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        top = self.stack[-1]
        if tag not in BLOCKS and top.tag == tag and top.depth:
            top.depth -= 1
        elif self.open.get(tag):
            if tag not in BLOCKS and any(e.tag in BLOCKS for e in self.stack[self._last(tag) :]):
                return  # an inline end tag closes no block
            while self.stack[-1].tag != tag:
                self._end_block()
                self._pop()
            self._end_block()
            self._pop()
        elif tag in BLOCKS:
            self._end_block()

    def _last(self, tag: str) -> int:
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].silent:
            self.words.append(data)
            if self.links:
                self.linked += len(data)

    def read(self, html: str) -> Page:
        self.feed(html)
        # What the parser still holds is text, or a comment, tag or script without an end.
        if self.cdata_elem or re.match(r"<(?:[a-zA-Z/!?]|$)", self.rawdata):
            self.rawdata = ""
        self.close()
        while len(self.stack) > 1:
            self._end_block()
            self._pop()
        self._end_block()
        return self


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing along the page, weights renormalised at the edges."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(i - j)]
            total, weight = total + w * values[j], weight + w
        out.append(total / weight)
    return out


def _inheriting(up: dict[int, tuple[int, bool]], regions: set[int], filled: dict) -> set[int]:
    """Nested containers that stand in a region, wrappers without a text of their own aside."""
    within: dict[int, bool] = {0: False}
    for c in range(1, len(up)):  # a container's number is above that of the one around it
        around = up[c][0]
        within[c] = around in regions or (within[around] if around not in filled or up[around][1] else False)
    return {c for c, found in within.items() if found and up[c][1]}


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page, its blocks joined by two line breaks."""
    if not html:
        return ""
    page = Page().read(html)
    return _select(page, _levels(page.blocks), sigma)


def _levels(blocks: list[Block]) -> list[int]:
    """Evidence against every block. Forms are evidence unless they hold the named article, or
    four fifths of the text that nothing else speaks against."""
    clear = [b for b in blocks if not b.around.evidence and not b.around.never]
    named = [b.around.forms for b in clear if b.around.article]
    outside = sum(b.own for b in clear if not b.around.forms)
    if named:
        forms = min(named) == 0
    else:
        forms = sum(b.own for b in clear) <= 5 * outside
    return [b.around.evidence + (b.around.forms if forms else 0) for b in blocks]


def _trimmed(picked: list[bool], containers: list[int], dense: list[bool], up: dict[int, tuple[int, bool]]) -> list[bool]:
    """Clusters of picked blocks without the ends that only their neighbours lifted: those that
    are not dense, in a container without a dense block in it or beside it."""
    filled = {c for c, p, d in zip(containers, picked, dense) if p and d}
    filled |= {up[c][0] for c in filled if up[up[c][0]][0]}  # not the whole page
    solid = [d or c in filled or (up[c][0] in filled and up[up[c][0]][0] > 0) for c, d in zip(containers, dense)]
    out = list(picked)
    for order in (range(len(picked)), range(len(picked) - 1, -1, -1)):
        reached = False
        for i in order:
            reached = picked[i] and (reached or solid[i])
            out[i] = out[i] and reached
    return out


def _select(page: Page, levels: list[int], sigma: float, lowered: float = 0.01) -> str:
    blocks = page.blocks
    ratios = [b.own / max(1, b.tags) for b in blocks]
    least = min((v for v, r in zip(levels, ratios) if r > 0), default=None)
    if least is None:
        return ""
    clear = [v == least and not b.around.never for v, b in zip(levels, blocks)]
    if all(b.around.strong for b, c in zip(blocks, clear) if c) and sum(b.own for b, c in zip(blocks, clear) if c) < 200:
        return ""  # a few words in nothing but furniture
    weights = [lowered ** max(0, v - least) for v in levels]
    ratios = [r * w for r, w in zip(ratios, weights)]
    smoothed = smooth(ratios, sigma)
    mean = sum(smoothed) / len(smoothed)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in smoothed) / len(smoothed))
    threshold = max(min(deviation, mean / 2), mean / 10)
    picked = [r > 0 and s * w > threshold and (r > threshold or 2 * b.linked <= len(b.text)) for b, r, s, w in zip(blocks, ratios, smoothed, weights)]
    picked = _trimmed(picked, [b.around.container for b in blocks], [r > threshold for r in ratios], page.up)
    named = [b.around.article and c for b, c in zip(blocks, clear)]
    if any(p and n for p, n in zip(picked, named)):  # the article is named: its region only
        picked = [p and n for p, n in zip(picked, named)]
        inside = named
    else:
        inside = clear
    chars: dict[int, list[int]] = {}
    for b, p, n in zip(blocks, picked, inside):
        if n:
            pair = chars.setdefault(b.around.container, [0, 0])
            pair[0] += len(b.text)
            pair[1] += len(b.text) if p else 0
    regions = {c for c, (whole, some) in chars.items() if 2 * some >= whole}
    kept = [p or (n and b.around.container in regions) for b, p, n in zip(blocks, picked, inside)]
    within = _inheriting(page.up, regions, chars)
    own = [n and 2 * b.linked <= len(b.text) for b, n in zip(blocks, inside)]  # not mostly links
    held: list[int] = []  # nested blocks since the last kept one, if nothing else came between
    open_run = False
    for i, b in enumerate(blocks):
        if not kept[i] and own[i] and b.around.container in within:
            kept[i] = True
        if kept[i]:
            for j in held if open_run else ():
                kept[j] = True
            held, open_run = [], True
        elif own[i] and page.up[b.around.container][1]:
            held.append(i)
        elif own[i]:
            held, open_run = [], False
    return "\n\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html``, with ``out`` (the main text, empty if none), which takes the
    place of a column of that name."""

    @F.pandas_udf("string")
    def text(bodies):
        return bodies.map(main_text, na_action=None)

    kept = [F.col(quoted(c)) for c in pages.columns if c not in (html, out)]
    return pages.select(*kept, text(F.col(quoted(html))).alias(out))
