"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its word count and link density, those of the blocks
before and after it, how many blocks of links stand in a row there, and what its place says: whether a boilerplate element
(nav, footer, aside) or the page's article holds it, and how much the names (class, id) of what holds it speak of
boilerplate. Which element is the article is decided by text: article and main elements are candidates, and one that holds
the page's heading or enough of its unlinked words is taken; teaser cards and comments in article elements are not. A name
decides nothing by itself: with it goes the share of the page's or article's words that the named element holds, so that
a wrapper called "has-sidebar" and a sidebar differ; names outside an article don't count inside it. A decision tree, grown
from the small labelled table below, says which blocks are main text; those are joined by line feeds in page order.

Null or empty html gives an empty text; unclosed tags, comments and scripts run to the page's end as in HTML, and a link
to its end tag or the next link, over blocks; blocks that repeat stay; of candidates that tie the first is the article; a page of any length is one unit, held by one
task, and read once from start to end; rows with null or equal ids stay rows; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# HTML element names by role, and words of class names.
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button option datalist".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot sidebar side aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations more pagination pager tags copyright legal disclaimer skip toolbar contentinfo complementary dfp slot teaser teasers partner partners promoted taboola outbrain".split()
)
ARTICLE_WORDS = frozenset("article content main post entry story body text page".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?-->|.*)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|$)",
    re.S,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden|href|name)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
#: Elements that a sibling's start tag ends.
_IMPLIED = {"li": frozenset(["li"]), "p": frozenset(["p"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "boilerplate_tag", "article_tag", "article_on_page", "boilerplate_name", "share_of_named", "linked_run", "article_name", "heading", "paragraph",
)


@lru_cache(10_000)
def _says(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, float, bool, bool]:
    """What an element's start says of what it holds: (boilerplate element, article element, share of boilerplate words in its names, article words in them, hidden).

    Inside an article a header is the article's."""
    words: list[str] = []
    hidden, role = False, ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            words += [w.lower() for w in _WORD.findall(value)]
    if tag in ("body", "html"):
        return False, False, 0.0, False, hidden
    bad = [w for w in words if w in BOILERPLATE_WORDS and not (inside and w == "header")]
    # a form may be a page's wrapper, so it is a little less than a name of nothing but boilerplate
    named = 0.95 if tag == "form" else len(bad) / len(words) if bad else 0.0
    return tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES, tag in ARTICLE_TAGS or role in ARTICLE_TAGS, named, not bad and any(w in ARTICLE_WORDS for w in words), hidden


@lru_cache(10_000)
def _is_link(attrs: str) -> bool:
    """An anchor that only has a name is no link."""
    names = {m[1].lower() for m in _ATTR.finditer(attrs)}
    return "href" in names or not names & {"name", "id"}


class Block:
    """A flat block: its text, words, words in links, and its place; top is whether it is a heading of the first level."""

    __slots__ = ("text", "words", "linked", "boilerplate", "region", "good", "heading", "paragraph", "top")


class Region:
    """What an element holds: the blocks from first to end. named is the share of boilerplate words in its names; around
    the number of the region around it; order counts elements as they open; candidate is None or whether it may be the article."""

    __slots__ = ("named", "first", "end", "around", "order", "parent", "candidate", "main")

    def __init__(self, named: float, first: int, around: int, order: int, parent: int, candidate: bool | None, main: bool):
        self.named, self.first, self.end, self.around, self.order, self.parent, self.candidate, self.main = named, first, first, around, order, parent, candidate, main

    def holds(self, other: Region) -> bool:
        return self.order < other.order and self.first <= other.first and other.end <= self.end


#: Of the page's unlinked words, the share that makes a candidate the article: if it alone has a heading of the first level
#: (or is the only candidate, not mostly links, and no one has such a heading), if no one has, if another place has one.
ENOUGH = {"own": 0.0, "none": 0.25, "other": 0.5}
#: Of a candidate's unlinked words, what a candidate in it must hold to be taken in its place, and one beside it to be taken too.
WITHIN, BESIDE = 0.6, 0.5


class Page:
    """A page's blocks, the regions that named elements and candidates for the article are, and the article: some regions, or none."""

    def __init__(self, page: str | None):
        self.blocks: list[Block] = []
        self.regions: list[Region] = []
        if page:
            self._read(page)
        self.article = self._chosen()

    def _read(self, page: str) -> None:
        text: list[str] = []
        linked: list[str] = []
        # of each open element: tag, boilerplate, region before, article name before, hidden, its own region, whether it is a candidate, its number
        stack: list[tuple] = []
        opened: Counter[str] = Counter()
        boilerplate = hidden = links = heading = paragraph = top = articles = order = 0
        region, good = -1, False

        def close() -> None:
            nonlocal heading, paragraph, top
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined and not hidden:
                    b = Block()
                    b.text, b.words = joined, joined.count(" ") + 1
                    b.linked = min(b.words, len(entities.unescape("".join(linked)).split())) if linked else 0
                    b.boilerplate, b.region, b.good, b.heading, b.paragraph, b.top = boilerplate > 0, region, good, heading, paragraph, top
                    self.blocks.append(b)
                text.clear()
                linked.clear()
            heading = paragraph = top = 0

        def leave() -> str:
            nonlocal boilerplate, region, good, hidden, articles
            tag, bad, around, was_good, was_hidden, own_region, was_article, _ = stack.pop()
            opened[tag] -= 1
            if own_region >= 0:
                self.regions[own_region].end = len(self.blocks)
            boilerplate, region, good, hidden, articles = boilerplate - bad, around, was_good, hidden - was_hidden, articles - was_article
            return tag

        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                lt = size
            if lt > at:
                text.append(page[at:lt])
                if links:
                    linked.append(page[at:lt])
                at = lt
                continue
            m = _TOKEN.match(page, at)
            if m is None:
                text.append("<")
                at += 1
                continue
            at = m.end()
            tag = m["tag"]
            attrs = m["attrs"] or ""
            end = m["end"]
            if tag is None:
                loose = _LOOSE.match(m[0])
                if loose is None or not m[0].endswith(">"):
                    continue
                end, tag = loose[1], loose[2]
            tag = tag.lower()
            if not end and tag in RAW:
                done = _CLOSE[tag].search(page, at)
                at = done.end() if done else size
                continue
            if tag == "a":
                links = int(not end and _is_link(attrs))
                continue
            if tag == "br":
                text.append(" ")
                if links:
                    linked.append(" ")
                continue
            if tag not in BLOCK and tag not in SKIPPED:
                if end:
                    if not opened[tag]:
                        continue
                elif not attrs or tag in VOID or not _says(tag, attrs, False)[4]:
                    continue  # an inline element, unless it is hidden
            close()
            if end:
                if opened[tag]:
                    while leave() != tag:
                        pass
                continue
            while stack and (stack[-1][0] in _IMPLIED.get(tag, ()) or stack[-1][0] == "p"):
                leave()
            if tag not in VOID and not attrs.endswith("/"):
                bad, article, named, article_name, hide = _says(tag, attrs, articles > 0)
                bad = bad or tag == "header" and not articles
                hide = hide or tag in SKIPPED
                order += 1
                own_region, before = -1, (region, good)
                candidate = article and not boilerplate and not bad
                if candidate or named and tag not in ("body", "html"):
                    own_region = len(self.regions)
                    self.regions.append(Region(named, len(self.blocks), region, order, stack[-1][-1] if stack else 0, candidate or None, tag == "main"))
                    region = own_region
                if candidate:
                    good = False
                elif named:
                    good = False
                elif article_name:
                    good = True
                stack.append((tag, bad, *before, hide, own_region, candidate, order))
                opened[tag] += 1
                boilerplate, hidden, articles = boilerplate + bad, hidden + hide, articles + candidate
            heading = int(len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
            top = int(tag == "h1")
            paragraph = int(tag in ("p", "blockquote", "pre"))
        close()
        while stack:
            leave()

    def _chosen(self) -> list[Region]:
        """The regions that are the article: decided by headings and unlinked words."""
        if not any(r.candidate for r in self.regions):
            return []
        upto, heads = _sums(0 if b.boilerplate else b.words - b.linked for b in self.blocks), _sums(int(b.top and not b.boilerplate) for b in self.blocks)
        held = lambda r, of=upto: of[r.end] - of[r.first]
        # a candidate in something that is called boilerplate and nothing else is a comment or a card
        fully = {k for k, r in enumerate(self.regions) if r.named == 1.0 and (held(r) < WITHIN * upto[-1] or r.candidate is not None)}
        for k, r in enumerate(self.regions):
            if r.around in fully:
                fully.add(k)
        known = [r for k, r in enumerate(self.regions) if r.candidate and k not in fully]
        if not known:
            return []
        best = max(known, key=lambda r: (r.main, held(r, heads) > 0, held(r), -r.order))
        where = "own" if held(best, heads) == heads[-1] > 0 else "other" if heads[-1] else "none"
        if where == "none" and len(known) == 1 and 2 * held(best) > sum(b.words for b in self.blocks[best.first : best.end] if not b.boilerplate):
            where = "own"
        if best.first == best.end or held(best) < ENOUGH[where] * upto[-1]:
            return []
        while inner := [r for r in known if best.holds(r) and held(r) >= WITHIN * held(best) and held(r, heads) == held(best, heads)]:
            best = max(inner, key=lambda r: (held(r), -r.order))
        return [r for r in known if r is best or r.parent == best.parent and held(r) >= BESIDE * held(best) > 0]

    def features(self) -> list[list[float]]:
        """A row of FEATURES for each block. Pages are short, so this is plain Python; rows of many pages are classified together."""
        found = self.blocks
        if not found:
            return []
        words = [b.words for b in found]
        density = [b.linked / b.words for b in found]
        runs = [0] * len(found)
        at = 0
        while at < len(found):  # blocks of links in a row, of one place: a menu after a linked line is no part of it
            to = at + 1
            if density[at] > 0.9:
                while to < len(found) and density[to] > 0.9 and found[to].region == found[at].region and found[to].boilerplate == found[at].boilerplate:
                    to += 1
                runs[at:to] = [to - at] * (to - at)
            at = to
        inside, most = self._named(words)
        rows, any_article = [], bool(self.article)
        before, before_density = 0, 0.0
        for i, b in enumerate(found):
            last = i + 1 == len(found)
            named, share = most[b.region] if b.region >= 0 else (0.0, 1.0)
            article = b.region >= 0 and inside[b.region] is not None and not b.boilerplate
            rows.append([
                words[i], density[i], before, before_density, 0 if last else words[i + 1], 0.0 if last else density[i + 1],
                b.boilerplate, article, any_article, named, share, runs[i], b.good, b.heading, b.paragraph,
            ])
            before, before_density = words[i], density[i]
        return rows

    def _named(self, words: list[int]) -> tuple[list[Region | None], list[tuple[float, float]]]:
        """Of each region the article (or None: the page) that it is in, and the share of boilerplate words and of the article's
        words of the region around it (or itself) that says most: a plain name, and not around everything.

        What is around an article says nothing of its inside; words that are boilerplate by element or by a plain name make
        nothing else's share smaller."""
        inside: list[Region | None] = []
        for r in self.regions:
            inside.append(r if any(r is y for y in self.article) else inside[r.around] if r.around >= 0 else None)
        if not any(r.named for r in self.regions):
            return inside, [(0.0, 1.0)] * len(inside)
        upto = _sums(words)
        whole = lambda of, sums: max(sums[of.end] - sums[of.first] if of is not None else sums[-1], 1)
        counts = [0 if b.boilerplate else b.words for b in self.blocks]
        for r, of in zip(self.regions, inside, strict=True):
            if r.named > 0.9 and upto[r.end] - upto[r.first] < WITHIN * whole(of, upto):
                counts[r.first : r.end] = [0] * (r.end - r.first)
        known = _sums(counts)
        most: list[tuple[float, int, float]] = []
        for k, (r, of) in enumerate(zip(self.regions, inside, strict=True)):
            own = (0.0, -1, 1.0)
            if r.named and r is not of and not any(r.holds(y) for y in self.article):
                sums = upto if r.named > 0.9 else known
                share = min(1.0, (sums[r.end] - sums[r.first]) / whole(of, sums))
                own = (r.named * (1 - share), k, share)
            most.append(max(own, most[r.around]) if r.around >= 0 and r is not of else own)
        return inside, [(self.regions[k].named if k >= 0 else 0.0, share) for _, k, share in most]


def _sums(values: Iterable[int]) -> list[int]:
    return [0, *accumulate(values)]


# --- the tree ------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 5) -> tuple:
    """A tree by Gini impurity: (feature, threshold, lower branch, upper branch), or (share of main text,) for a leaf."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones, k = np.cumsum(t)[:-1], np.arange(1, len(t))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(t) - k >= least)
        if not ok.any():
            continue
        a, b = ones / k, (t.sum() - ones) / (len(t) - k)
        loss = np.where(ok, k * a * (1 - a) + (len(t) - k) * b * (1 - b), np.inf)
        i = int(loss.argmin())
        if best is None or loss[i] < best[0] - 1e-12:
            best = (float(loss[i]), f, (v[i] + v[i + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,)
    _, f, at = best
    low = x[:, f] <= at
    return (f, at, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    f, at, low, high = tree
    left = x[:, f] <= at
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


#: Places of the labelled table that are filled with words: a long paragraph, a sentence or two, a phrase.
_L, _S, _P = "{long}", "{some}", "{few}"
_LENGTHS = {"long": (30, 90), "some": (8, 30), "few": (1, 7)}
_WORDS = "the river rose again in that night and people of a lower town carried what they could up hill no one had thought old wall would hold but it did by noon water began to fall".split()


# The labelled table. Elements with the attribute data-main are main text, all others are not.
#: Main text, with what may stand among it.
BODIES = (
    f"<h1 data-main>Flood in the lower town</h1><p data-main>{_L}</p><p data-main>Yes.</p><p data-main>{_S}</p>",
    f"<h1 data-main>Harvest</h1><p data-main>{_S}</p><h2 data-main>Later</h2><p data-main>{_L}</p><p data-main>The end.</p>",
    f"<p data-main>{_L}</p><p data-main>{_S}</p><p data-main>{_L}</p>",
    f"<p data-main>{_S}</p><p data-main>So it was.</p><ul><li data-main>Bread and salt</li><li data-main>Three candles</li></ul><p data-main>{_L}</p>",
    f"<h1 data-main>Wind</h1><p data-main>{_S}</p><p data-main><a>{_S}</a></p><p data-main>{_L}</p>",
    f"<h1 data-main>Night</h1><p data-main>{_S} <a>See the table</a></p><blockquote data-main>{_S}</blockquote><p data-main>Nobody spoke.</p><p data-main>{_L}</p>",
    f"<div data-main>{_L}</div><div data-main>{_S}</div><div data-main>{_L}</div>",
    f"<h2 data-main>One</h2><p data-main>{_L}</p><h2 data-main>Two</h2><p data-main>Few words.</p><h2 data-main>Three</h2><p data-main>{_S}</p>",
    f"<p data-main>{_S}</p><p data-main>So.</p><p data-main>No one spoke of it.</p><p data-main>{_S}</p>",
    f"<h1 data-main>Late trains</h1><span data-main>{_L}<br><br>{_S}</span>",
    f"<h1 data-main>Ice</h1><span data-main>{_S} {_S}</span><hr><span data-main>{_L}</span>",
)
#: Main text that only its article tells from a menu.
SHORT_BODIES = (
    "<h1 data-main>Snow</h1><p data-main>Short.</p><p data-main>Shorter.</p>",
    f"<h1 data-main>Bread</h1><p data-main><a>Whole line in a link</a></p><ul><li data-main><a>Flour</a></li><li data-main>Salt</li></ul><p data-main>{_S}</p>",
    "<p data-main>A word.</p>",
    "<h1 data-main><a>The old wall</a></h1><table><tr><td data-main>1900</td><td data-main>built</td></tr><tr><td data-main><a>1950</a></td><td data-main><a>fell</a></td></tr></table>",
    f"<div class='entry-header'><h1 data-main>Bridges</h1></div><p data-main>{_S}</p><p data-main>{_L}</p>",
    f"<h2 data-main>Letters</h2><p data-main><a>From the upper town</a></p><p data-main><a>{_S}</a></p><pre data-main>one two three</pre>",
)
#: What stands before and after, told by its length and links.
PLAIN = (
    "<div><a>Home</a> <a>World</a> <a>Sport</a></div>",
    "<div>Menu</div>",
    "<div><a>Home</a></div><div><a>{few}</a></div><div><a>{few}</a></div>",
    "<ul><li><a>{few}</a></li><li><a>{few}</a></li><li><a>{few}</a></li></ul>",
    "<div>Welcome to the paper</div><div>Search</div>",
    "<div>Imprint</div><div><a>Terms of use of this paper</a></div>",
    "<table><tr><td><a>Front page</a></td><td><a>{few}</a></td></tr></table>",
    "<div><a>Terms</a> <a>Privacy</a></div><div>All rights reserved.</div>",
    "<h3>Links</h3><ul><li><a>C</a></li><li><a>D</a></li></ul><h3>Partners</h3><ul><li><a>{few}</a></li></ul>",
    "<div>Made with care in the lower town</div>",
    "<a><div>Ten more stories that you may want to read after this one</div></a>",
    "<div><a>News</a></div><div><a>Shop</a></div>",
    "<h2>Also</h2><div><a>{few}</a></div>",
    "<h3>What others read</h3><ul><li><a>Bread</a></li><li><a>{few}</a></li></ul>",
    "<ul><li><a>Weather</a></li><li><a>{few}</a></li></ul>",
)
#: The same, told by its element or name, whatever it says.
NAMED = (
    "<nav><ul><li><a>Home</a></li><li><a>News</a></li><li>About us</li></ul></nav>",
    "<nav><a>Home</a></nav>",
    f"<header><p>The Paper</p><p>{_S}</p><a>Sign in</a></header>",
    f"<footer><p>{_L}</p><p>&copy; 2001 The Paper</p></footer>",
    "<div class=ad>Buy two shoes today and pay for one.</div>",
    f"<div class='ad-banner'><p>{_S}</p></div>",
    "<div class='cookie-notice'><p>We use cookies to make this site work and to learn how it is used. You can change that at any time.</p><p>OK</p></div>",
    f"<aside><p>Also of interest to our readers this week:</p><p>{_S}</p><a>Ten ways to cook a carp</a></aside>",
    f"<div class=sidebar><p>{_S}</p><a>Archive</a></div>",
    "<form><p>Your name and address, please, so that we can send you the paper every week of the year.</p><p>Send</p></form>",
    f"<div id=newsletter><h2>Letters</h2><p>{_S}</p></div>",
    f"<div role=navigation><p>{_S}</p></div>",
    f"<section class=related><h3>More of this</h3><p>{_S}</p><p>{_S}</p></section>",
    f"<div class='col-3 site-sidebar-left'><p>{_S}</p><p>Archive</p></div>",
    f"<div class='td-footer-wrap container'><p>{_S}</p></div>",
    "<div id=header><h1>The Paper</h1></div>",
    "<header><h1>The Paper</h1><p>A paper for the lower town</p></header>",
    "<div class='site-header top'><h1><a>The Paper</a></h1></div>",
)
#: What stands inside an article or after its text and is none of it.
INNER = (
    f"<aside><p>{_S}</p></aside>",
    "<div class=share><a>Share</a></div>",
    f"<div class=comments><article><p>{_L}</p></article><p>First!</p><article><p>{_L}</p></article></div>",
    f"<section id=comments><p>{_S}</p><p>I was there too.</p><p>{_L}</p></section>",
    "<form><p>Give us your mail address and we shall write to you.</p></form>",
    "<nav><a>Part two of this long story</a></nav>",
    "<footer><p>Written by the night desk.</p></footer>",
    "<div class=ad>Buy two shoes today, and pay for one of them a year from now.</div>",
    f"<ul class='comment-list'><li><p>{_L}</p></li><li><p>{_S}</p></li><li><p>{_L}</p></li></ul>",
    "<p class=tags><a>River</a> <a>Town</a></p>",
    "<div class='jp-block sd-sharing'><a>Share on paper</a></div>",
    f"<div class='list-of related-posts wide'><p>{_S}</p><p><a>{_S}</a></p></div>",
    f"<div class='box newsletter-box wide'><p>{_S}</p></div>",
    "<div class=dfp-slot>Buy two shoes today, and pay for one of them a year from now.</div>",
    "<ul><li><a>{few}</a></li><li><a>{few}</a></li><li><a>{few}</a></li></ul>",
    "<div><a>Bread</a></div><div><a>{few}</a></div><div><a>Candles</a></div><div><a>The old wall</a></div>",
    "<div class=social-share><a>Send it</a> <a>Print it</a></div>",
    f"<div class=ad><p>{_S}</p></div>",
    f"<div class='mail newsletter'><p>{_S}</p></div>",
    f"<div class='box newsletter-box'><p>{_S}</p></div>",
    f"<section class='latest related'><p>{_S}</p><p>{_S}</p></section>",
    f"<div class='box tall wide promo-box two'><p>{_S}</p></div>",
    f"<div class='social-links share'><p>{_S}</p></div>",
    f"<div class='block one-of sponsored'><p>{_S}</p><p><a>{_S}</a></p></div>",
)
#: Cards and comments in article elements outside the article.
CARDS = (
    "<section><h2>Read next</h2><article><a>{few}</a></article><article><a>{few}</a></article></section>",
    "<div><article><a>{few}</a></article></div>",
    "<div><h2>Next</h2><article><a>{few}</a></article></div>",
    "<section><h3>From the paper of today</h3><article><a>Bread</a></article><article><a>{few}</a></article></section>",
    "<section><article><h3><a>{few}</a></h3><p>What came of the old wall in the end.</p></article><article><h3><a>{few}</a></h3><p>Bread is dear again.</p></article></section>",
    f"<ol><li><article><p>{_S}</p></article></li><li><article><p>I was there too.</p></article></li></ol>",
)
#: Pages of each frame and body.
REPEATS = 6
#: How pages are put together. Wrappers have names that speak of what else is on the page.
ARTICLE_FRAMES = (
    "{top}<article>{body}</article>{end}",
    "{top}<main>{body}{inner}</main>{end}",
    "{top}<article>{body}{inner}</article>{side}{end}",
    "<div class='layout has-sidebar'>{top}<article>{body}</article>{side}{end}</div>",
    "<div class=no-comments>{top}<article>{body}{inner}</article>{end}</div>",
    "<div class=post-share-enabled>{top}<main><article>{body}</article>{inner}</main>{end}</div>",
    "<div class='page with-header'>{top}<article><header>{body}</header></article>{side}{end}</div>",
    "<div class='story related-content'><article>{body}</article></div>{end}",
    "<form id=all>{top}<article>{body}</article>{end}</form>",
    "{top}<article><div class='text with-ads'>{body}</div>{inner}</article>{side}",
    "{top}<section><article>{body}</article><div class=discussion>{side}</div></section>{end}",
    "{top}<article>{inner}{body}</article>{end}",
    "{top}<main>{body}</main>{cards}{end}",
    "<article><div class='text more'>{body}</div></article>{end}",
    "{top}<article><div class='text wide left more'>{body}</div>{inner}</article>{end}",
    "{top}<article><div class='tall wide left text more'>{body}</div>{inner}</article>{side}",
    "{top}<article><div class='share related text'>{body}</div>{inner}</article>{side}",
    "{top}<article><div class='one-of two with-ads'>{body}</div>{inner}</article>{end}",
    "{top}<article><h1 data-main>Low water</h1><div class='text more'>{body}</div>{inner}</article>{side}",
    "{top}<article><h1 data-main>To the editors</h1><div class=form-letter>{body}</div></article>{cards}",
)
NAME_FRAMES = (
    "{top}<div class=content>{body}</div>{side}{end}",
    "<div class='layout has-sidebar'>{top}<div class=content>{body}{inner}</div>{side}{end}</div>",
    "<div class=no-comments>{top}{body}{end}</div>",
    "<div class='page with-header'>{top}{body}{inner}</div>",
    "{top}<div class='story related-content'>{body}</div>{end}",
    "<form id=all>{top}<div id=main>{body}</div>{side}{end}</form>",
    "{top}<div class='post-share-enabled'>{body}</div>{inner}{end}",
    "{top}<section>{body}{inner}</section>{side}",
    "{top}{body}{end}",
    "{body}{inner}",
    "{top}<div id=content><h1 data-main>Bridge</h1>{body}</div>{cards}{end}",
    "<div id=content>{body}</div>{cards}",
    "{top}<div class='text more'>{body}</div>{cards}{side}",
    "{top}<div class='text wide left more'>{body}{inner}</div>{side}",
    "{top}<div class='share related text'>{body}</div>{cards}{end}",
)
PLAIN_FRAMES = ("{top}{body}{end}", "<div>{top}</div><div>{body}</div><div>{end}</div>", "<table><tr><td>{top}</td><td>{body}</td></tr></table>{end}", "{body}{end}", "{top}{body}", "{body}")


def labelled_pages() -> list[str]:
    """The table's pages: each frame with each body REPEATS times, and around them parts, and lengths of text, that a fixed seed draws."""
    rng, pages = np.random.default_rng(5), []
    one = lambda parts: parts[int(rng.integers(len(parts)))]

    def words(m: re.Match) -> str:
        low, high = _LENGTHS[m[1]]
        return " ".join(rng.choice(_WORDS, int(rng.integers(low, high)))).capitalize() + "." * (m[1] != "few")

    for frames, bodies, around in ((ARTICLE_FRAMES, (*BODIES, *SHORT_BODIES), (*PLAIN, *NAMED)), (NAME_FRAMES, BODIES, (*PLAIN, *NAMED)), (PLAIN_FRAMES, BODIES, PLAIN)):
        for frame, body, _ in product(frames, bodies, range(REPEATS)):
            page = frame.format(top=one(around) + one(("", one(around))), body=body, inner=one(INNER), side=one(NAMED), cards=one(CARDS), end=one(around) + one(("", one(around))))
            pages.append(re.sub(r"\{(long|some|few)\}", words, page))
    return pages


def marked(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a labelled page's blocks, and which of them are main text."""
    # the mark goes into the text, so that labelled blocks are found by the same parser
    found = Page(re.sub(r"<(\w+)([^>]*) data-main([^>]*)>", "<\\1\\2\\3>✓ ", page))
    main = np.array([b.text.startswith("✓") for b in found.blocks], float)
    for b, yes in zip(found.blocks, main, strict=True):
        b.words -= int(yes)
        b.linked = min(b.linked, b.words)
    return np.array(found.features(), float).reshape(-1, len(FEATURES)), main


@lru_cache(1)
def trained() -> tuple:
    xs, ys = zip(*(marked(p) for p in labelled_pages()), strict=True)
    return grow(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None) -> str:
    return main_texts([Page(page)], trained())[0]


def main_texts(pages: list[Page], tree: tuple) -> list[str]:
    rows = [row for p in pages for row in p.features()]
    main = iter(classify(tree, np.array(rows, float)).tolist() if rows else ())
    return ["\n".join([b.text for b in p.blocks if next(main)]) for p in pages]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars, n_blocks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Page(html) for html in batch.column(2).to_pylist()]
        texts, counts = main_texts(found, tree), [len(p.blocks) for p in found]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    tree = trained()
    df = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return c.map_text(df, run, "page_id long, url string, text string, n_chars long, n_blocks int", "html")
