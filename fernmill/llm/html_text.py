"""Main text of web pages from parser events, by smoothed text-to-tag ratios.

The standard library's parser is fed piece by piece and turns a page into blocks
of text, each with the tags and links it holds and the element it stands in.
The ratio of text to tags of each block is smoothed by a Gaussian, less across
the bounds of elements, and clustered against a threshold. The least element
around the clustered blocks is the content region; its blocks are the text, and
where it is the page's body, only those of parts with a cluster and what
stands between them. Elements whose tag says that they are a menu or footer form no
cluster and are left out of the region. Nor do forms, and containers that name
themselves as adverts, comments and the like, unless they hold most of the page's
text and little stands beside them: names never overrule where the text is. An
article or main element around the region is kept whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements by their part in the layout.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head title script style noscript template svg iframe object canvas audio video map select textarea datalist".split())
ASIDE = set("nav aside footer button menu dialog search".split())
FORMS = {"form", "fieldset"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROOTS = set("html body main article".split())
#: Elements whose end is implied by a sibling's start, with what bounds the search for one.
IMPLIED = {"p": BLOCK - {"p"}, "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}}
CLOSES = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Containers, and words in their class, id or role that say what they are.
CONTAINERS = set("div section aside nav ul ol dl table header footer form figure details blockquote span".split())
NOT_ARTICLE = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar toolbar header footer colophon sidebar sidenav aside widget widgets recommended recommendations "
    "notice notices cookie cookies consent gdpr banner popup modal overlay lightbox toast interstitial ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsored sponsors promo promoted "
    "comment comments commentlist replies respond disqus share sharing newsletter subscribe subscription signup signin login searchbox pagination pager contentinfo complementary dialog".split()
)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_UNDONE = {"no", "has", "with", "without", "off"}
_REPLIES = set("comment comments commentlist replies respond disqus".split())

#: Width of the Gaussian in blocks, what a bound of elements leaves of it, and the threshold as a share of the ratios' deviation.
SIGMA, ACROSS, CUT = 1.0, 0.1, 0.5
#: Share of the main container's text, or of its mean smoothed ratio, that others need for their clusters to count.
MASS, LIKE = 0.15, 0.4
#: What stands beside a container that names itself as something else, as a share of its text, where it is the page's text all the same; the same for comments.
BESIDE, BESIDE_REPLIES = 0.25, 0.05
#: Characters fed to the parser at a time.
PIECE = 1 << 16


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) for name, value in attrs)


def _named(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words by which a container names itself as no part of an article."""
    found: set[str] = set()
    if tag in CONTAINERS:
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for part in value.split():
                    own = {w.lower() for w in _SPLIT.split(part)}
                    if _UNDONE.isdisjoint(own):
                        found |= NOT_ARTICLE & own
    return found


class _Blocks(HTMLParser):
    """Collects (text, tags, linked characters, element, set aside, container that names itself, within an article) for each block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents = [-1]
        self.tags = ["#"]
        # (tag, element, unseen, set aside, header without article, within an article, container that names itself)
        self.stack: list[tuple[str, int, bool, bool, bool, bool, int]] = [("#", 0, False, False, False, False, -1)]
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, int, int, bool, int, bool]] = []
        self.outer: list[int] = []  # of containers that name themselves, the one around each
        self.replies: list[bool] = []  # whether one names itself as comments
        self.parts: list[str] = []
        self.inline = self.linked = self.anchors = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, element, _, aside, header, article, named = self.stack[-1]
                self.blocks.append((text, self.inline, min(self.linked, len(text)), element, aside or header, named, article))
            self.parts = []
        self.inline = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            else:
                self.inline += 1
                if tag == "br":
                    self.parts.append(" ")
            return
        if tag not in BLOCK and tag not in UNSEEN and tag not in ASIDE:
            self.inline += 1
            self.anchors += tag == "a"
            if _hidden(attrs) or _named(tag, attrs):
                self._push(tag, attrs)
            return
        self.flush()
        if tag in IMPLIED:
            self._close(CLOSES.get(tag, {tag}), IMPLIED[tag])
        elif tag in BLOCK:  # a block ends an open paragraph
            self._close({"p"}, BLOCK - {"p"})
        self.anchors = 0
        self._push(tag, attrs)

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, parent, unseen, aside, header, article, named = self.stack[-1]
        self.parents.append(parent)
        self.tags.append(tag)
        self.open[tag] += 1
        if tag in HEADINGS and header and self.open["article"]:
            header = False  # an article's own header holds its title
        if tag not in ROOTS and tag not in ("header", *HEADINGS):
            aside = aside or tag in ASIDE or _hidden(attrs)
            says = _named(tag, attrs)
            if tag in FORMS or says:
                self.outer.append(named)
                self.replies.append(not _REPLIES.isdisjoint(says))
                named = len(self.outer) - 1
        self.stack.append((tag, len(self.tags) - 1, unseen or tag in UNSEEN, aside, header or tag == "header", article or tag in ("article", "main"), named))

    def _close(self, tags: set[str], bound: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in tags:
                self.open.subtract(x[0] for x in self.stack[at:])
                del self.stack[at:]
                return
            if self.stack[at][0] in bound:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag not in BLOCK and tag not in UNSEEN and tag not in ASIDE:
            self.anchors = max(0, self.anchors - (tag == "a"))
            if self.stack[-1][0] == tag:
                self.flush()
                self.stack.pop()
                self.open[tag] -= 1
            return
        self.flush()
        self.anchors = 0
        # An end tag closes its element, but never one that the present region stands in.
        bound = set() if tag in ROOTS or tag in ("div", "section", *UNSEEN, *ASIDE, "header") else {"article", "main", "section", "div", "body", *ASIDE, *UNSEEN}
        self._close({tag}, bound - {tag})

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


def _smooth(ratio: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """Ratios smoothed by a Gaussian; neighbours count for less where they stand in another container."""
    total, weight = ratio.copy(), np.ones(len(ratio))
    for reach in (1, 2):
        part = np.exp(-(reach**2) / (2 * SIGMA**2)) * np.where(homes[reach:] == homes[:-reach], 1.0, ACROSS)
        total[reach:] += part * ratio[:-reach]
        total[:-reach] += part * ratio[reach:]
        weight[reach:] += part
        weight[:-reach] += part
    return total / weight


def _clusters(ratio: np.ndarray, homes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which blocks are clustered: those above the threshold in containers like the one that holds most of them.

    A container of little text counts if its ratio is like that of the main one.
    """
    smooth = _smooth(ratio, homes)
    seeds = smooth >= CUT * ratio.std()
    if not seeds.any():
        return np.ones(len(ratio), bool)
    known, own = np.unique(homes[seeds], return_inverse=True)
    mass = np.bincount(own, sizes[seeds])
    mean = np.bincount(own, (smooth * sizes)[seeds]) / mass
    main = mass.argmax()
    alike = (mass >= MASS * mass[main]) | (mean >= LIKE * mean[main])
    return seeds & np.isin(homes, known[alike])


def _home(element: int, parents: list[int], tags: list[str]) -> int:
    """The container that a block's element stands in."""
    return element if tags[element] in ROOTS or tags[element] in ("#", "div", "section") else parents[element]


def _kept(parser: _Blocks) -> list[tuple]:
    """Blocks that are not set aside, by their tag or by the name of a container that isn't the page's text.

    Of containers that name themselves only those around each other can hold more
    than half of the text; such a one counts as any other, if no article stands
    beside it and what does is little.
    """
    shown = [b for b in parser.blocks if not b[4]]
    own, article = [0] * len(parser.outer), [False] * len(parser.outer)
    beside, outside = 0, False
    for text, _, linked, _, _, named, within in shown:
        if named >= 0:
            own[named] += len(text) - linked
            article[named] |= within
        else:
            beside += len(text) - linked
            outside |= within
    whole, total = own[:], beside + sum(own)
    for k in range(len(own) - 1, -1, -1):  # those inside come later
        if parser.outer[k] >= 0:
            whole[parser.outer[k]] += whole[k]
    counts = [False] * len(own)
    for k, around in enumerate(parser.outer):
        if 2 * whole[k] > total and (around < 0 or counts[around]) and not outside and beside < (BESIDE_REPLIES if parser.replies[k] else BESIDE) * whole[k]:
            counts[k] = True
            beside, outside = beside + own[k], article[k]
    return [b for b in shown if b[5] < 0 or counts[b[5]]]


def _region(homes: list[int], parents: list[int], tags: list[str]) -> int:
    """The least element around all given ones, or the article or main element around that."""
    holds, wanted, best = [0] * len(parents), set(homes), 0
    for home in wanted:
        holds[home] = 1
    for at in range(len(parents) - 1, -1, -1):  # children come after their parents
        if holds[at] == len(wanted):
            best = at
            break
        if parents[at] >= 0:
            holds[parents[at]] += holds[at]
    at, outer = best, -1
    while at >= 0:
        if tags[at] in ("article", "main") and tags[outer] != "article":
            outer = at
        at = parents[at]
    return outer if outer >= 0 else best


def _branches(region: int, parents: list[int]) -> list[int]:
    """For each element the region's child that it stands in, the region itself if none, -1 outside of it."""
    out = [-1] * len(parents)
    out[region] = region
    for at in range(region + 1, len(parents)):
        around = parents[at]
        out[at] = at if around == region else out[around]
    return out


def _complete(html: str) -> str:
    """A page without a comment or tag that its end cuts off."""
    opened = html.rfind("<!--")
    if opened >= 0 and html.find("-->", opened) < 0:
        html = html[:opened]
    opened = html.rfind("<")
    if opened >= 0 and html.find(">", opened) < 0 and (html[opened + 1 : opened + 2].isalpha() or html[opened + 1 : opened + 2] in ("/", "!")):
        html = html[:opened]
    return html


def main_text(html: str | None) -> str:
    """Text of a page's article; blocks in page order, joined by a line end.

    Character references are decoded, white space inside a block becomes one
    space, and nothing else is dropped or cut. Null or empty pages, and pages
    without content, give an empty string. Broken markup is read as far as it goes.
    """
    parser, html = _Blocks(), _complete(html or "")
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    parser.flush()
    parents, tags = parser.parents, parser.tags
    blocks = _kept(parser)
    if not blocks:
        return ""
    ratio = np.array([(len(b[0]) - b[2]) / (1 + b[1]) for b in blocks])
    homes = [_home(b[3], parents, tags) for b in blocks]
    seeds = _clusters(ratio, np.array(homes), np.array([len(b[0]) for b in blocks]))
    region = _region([h for h, seed in zip(homes, seeds.tolist(), strict=True) if seed], parents, tags)
    branches = _branches(region, parents)
    branch = np.array([branches[h] for h in homes])
    own = np.flatnonzero(branch >= 0)
    if tags[region] not in ("article", "main"):
        # Parts of the body without a cluster go, unless they stand between clusters and are no links.
        held = set(branch[seeds].tolist())
        first, last = np.flatnonzero(seeds)[[0, -1]]
        linked = np.array([2 * b[2] > len(b[0]) for b in blocks])
        # A heading right before the first cluster is its title.
        while first and not linked[first - 1] and branch[first - 1] >= 0 and tags[blocks[first - 1][3]] in HEADINGS:
            first -= 1
        between = (np.arange(len(blocks)) >= first) & (np.arange(len(blocks)) <= last)
        own = own[np.array([(branch[i] in held and not (linked[i] and not between[i])) or (between[i] and not linked[i]) for i in own], bool)]
        if tags[region] in ("#", "html", "body"):  # what stands in the body itself is a part of its own
            own = own[np.array([branch[i] != region or between[i] or seeds[i] for i in own], bool)]
    return "\n".join(blocks[i][0] for i in own)


def extract(html: Column) -> Column:
    """Column form of :func:`main_text`."""

    @F.pandas_udf("string")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(x) for x in pages], dtype=object)

    return udf(html)
