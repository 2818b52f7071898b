"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements; each has a hidden label, content or not.
A node's potential is a sum of learnt weights, one for the value of each of its
features (``SLOTS``): tag, length and link share of its own text, of its subtree
and of its parent's, words in its class, id or role that tell of boilerplate
(its own, and the nearest ones around it), and where it stands to the page's
chief article. No word decides by itself: each is a feature with a weight. A
parent-child potential has a learnt weight for every pair of labels and kind of
child. Messages are passed from the leaves to the root and back (sum-product),
which gives every node's exact marginal. Blocks of nodes that are more likely
content than not are the main text.

The weights maximise the conditional likelihood of labelled pages, whose
gradient takes the same messages: pages labelled by hand (``LABELLED``) that hold
the exceptions both ways, and a bounded sample of the table's pages that mark
their article (``train_pages`` of at most ``train_nodes`` nodes), labelled by
those marks but *shown to the model without them*: they teach what content looks
like, and the marks' own weights come from the pages labelled by hand alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, smallest_hashes

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
#: Elements whose inside is not text of the page; the first four run to the page's end if unclosed.
_RAW = frozenset("script style title textarea".split())
_SKIPPED = _RAW | frozenset("noscript template iframe object svg select option canvas audio video annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var td th".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 "
                      "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "option": "option", "p": "p"}
_BLOCKS = _CLOSES_P | frozenset("body html li dt dd tr td th".split())
_SCOPES = frozenset("ul ol dl table article section div body html main".split())

_OPENERS = frozenset("article main".split())
#: Groups of marks (feature values; the weights are learnt) and the words of names that fall into them.
_MARKS = {
    "hidden": "hidden",
    "comments": "comment comments commentlist disqus respond responses replies reply reviews feedback",
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay",
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip toc",
    "foot": "footer masthead copyright",
    "share": "share sharing social subscribe subscription newsletter signup login",
    "aside": "sidebar widget widgets",
    "form": "search form",
    "vague": "discussion side related recommended recommendations follow tags tagcloud",
}
MARKS = ["none", *_MARKS, "head"]
_MARK_ID = {m: i for i, m in enumerate(MARKS)}
_WORD_MARK = {w: _MARK_ID[m] for m, words in _MARKS.items() for w in words.split()}
_TAG_MARK = {t: _MARK_ID[m] for t, m in (("nav", "navigation"), ("menu", "navigation"), ("footer", "foot"), ("aside", "aside"), ("form", "form"),
                                         ("button", "form"), ("dialog", "notice"), ("head", "head"))}
_MAIN_WORDS = frozenset("article post story entry content main maincontent articlebody postbody bodytext".split())
_WORDS = re.compile(r"[A-Za-z]+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([a-zA-Z-]+)""")

TAGS = ("root html body div section article main header footer nav aside ul ol li p h1 h2 h3 h4 h5 h6 blockquote pre figure "
        "figcaption table tr dl dt dd form address other").split()
_TAG_ID = {t: i for i, t in enumerate(TAGS)}
_LENGTHS, _AROUND, _LINKS = (1, 20, 80, 200), (1, 80, 300, 1000), (0.01, 0.3, 0.7)
#: Where a node stands: outside of articles, in the chief article, in another one, in the chief one beside its inner article.
OUTSIDE, CHIEF, OTHER, BESIDE = range(4)
_SHAPES = (len(_LENGTHS) + 1) * (len(_LINKS) + 1)
#: Features and their numbers of values; "stand" is the place combined with the nearest mark around the node (inside
#: the chief article: the nearest mark inside it), "outer" the nearest mark around the chief article.
SLOTS = {"tag": len(TAGS), "own": _SHAPES, "mark": len(MARKS), "stand": 4 * len(MARKS), "outer": len(MARKS), "subtree": _SHAPES, "around": _SHAPES}
_FIRST = np.cumsum([0, *SLOTS.values()])
FEATURES = int(_FIRST[-1])
#: Kinds of children for the pair potentials: plain, marked, opening an article.
KINDS = 3


def _filler(n: int) -> str:
    return "Some plain words of a text. " * n


#: Hand-labelled pages: elements with data-y="1", and what is inside them up to data-y="0", are content; all else is not.
LABELLED = tuple(h.replace("$5", _filler(10)).replace("$4", _filler(7)).replace("$3", _filler(5)).replace("$2", _filler(2)).replace("$1", "Few words.") for h in (
    "$1",
    # no marks at all
    "<body><div><a href=x>Home</a> <a href=x>News</a></div><div data-y=1><h1>A plain title</h1><p>$5</p><p>$5</p><p>$1</p></div><div>All rights reserved.</div></body>",
    "<body><table><tr><td><a href=x>One</a></td><td><a href=x>Two</a></td></tr></table><p data-y=1>$4</p><p data-y=1>$5</p><ul><li><a href=x>Next page</a></li>"
    "<li><a href=x>Last page</a></li></ul></body>",
    "<body><div><ul><li><a href=x>Start</a></li><li><a href=x>About us</a></li></ul></div><section data-y=1><h2>Heading</h2><blockquote>$3</blockquote><p>$4</p>"
    "<ul><li>$2</li><li>$2</li></ul></section><div><p><a href=x>See more of this</a></p></div></body>",
    "<body><header><h1><a href=x>Site name</a></h1><p>Its motto</p></header><div data-y=1><h1>Title of the page</h1><pre>$5</pre><p>$4</p></div>"
    "<div><div>Contact</div><div>Imprint</div></div></body>",
    "<body><div><div class=menu><ul><li><a href=x>Home</a></li></ul></div><div data-y=1><p>$5</p><p>$5</p></div><div id=cookie-notice><p>We use cookies. $5</p></div></div></body>",
    "<body><div class=menu><p>$1</p></div><div data-y=1><p>$4</p></div><div class=sidebar><p>$4</p></div><div class=ad>$4</div><div class=comments><p>$5</p><p>$4</p></div>"
    "<footer><p>$3</p></footer><div class=newsletter><p>$3</p></div><form><p>$3</p></form></body>",
    # boilerplate with marks in and around an article
    "<body><article data-y=1><h1>Marked article</h1><p>$4</p><div data-y=0 class=share><a href=x>Send</a></div><aside data-y=0><p>$3</p></aside><p>$4</p>"
    "<form data-y=0><p>Your name</p></form><section data-y=0 class=comments><h2>Replies</h2><p>$5</p><p>$1</p><ul><li>$4</li></ul></section></article>"
    "<div class=cookie-notice><p>$3</p></div></body>",
    "<body><nav><a href=x>Start</a></nav><article data-y=1><h1>T</h1><p>$1</p><div data-y=0 class=ad>buy</div><section data-y=0 class=comments><p>$2</p></section>"
    "<form data-y=0><p>Name</p></form><div data-y=0 class=notice>$2</div><nav data-y=0><ul><li><a href=x>Next</a></li></ul></nav><footer data-y=0>$1</footer></article>"
    "<aside><p>side words</p></aside><footer>me</footer></body>",
    "<main data-y=1><p>one<p>two<ul><li>a<li>b</ul>tail</main>", "<article data-y=1><p>$1</p></article>", "<article data-y=1>bare<div>deep</div></article>",
    "<article data-y=1><header><h1>Head</h1><p>$1</p></header><table><tr><td>1</td><td>2</td></tr></table></article>",
    "<article data-y=1><div><p>$1</p><div><blockquote>$2</blockquote></div></div><ul><li><a href=x>A source</a></li></ul><p><a href=x>A linked line</a></p></article>",
    "<body><header><p>$3</p></header><main data-y=1><p>$4</p><div data-y=0 class=sidebar><p>$4</p></div><div data-y=0 id=comments><article><p>$5</p></article><article><p>$5</p>"
    "</article></div><div data-y=0 hidden><p>$4</p></div><div data-y=0 class=ad-slot><p>$4</p></div></main><footer><div><p>$4</p></div></footer></body>",
    "<body><div class=nav><p>$2</p></div><div id=content data-y=1><h2>$1</h2><p>$3</p><div data-y=0 class=toolbar>$1</div><div data-y=0 class=subscribe><p>$3</p></div></div>"
    "<div class=footer><p>$4</p></div></body>",
    "<body><article data-y=1><h1>First</h1><p>$3</p></article><article data-y=1><h1>Second</h1><p>$1</p></article><div class=sidebar><article><p>$2</p></article></div></body>",
    # content inside marked wrappers
    "<body><div class=widget><article data-y=1><h1>T</h1><p>$3</p><p>$1</p></article></div></body>",
    "<body><div class=sidebar-layout><p>$1</p><article data-y=1><p>$4</p><p>$1</p></article></div></body>",
    "<body><div class=page-search><main data-y=1><p>$4</p><ul><li>$1</li></ul></main></div></body>",
    "<body><form><input><article data-y=1><h1>T</h1><p>$2</p><p>$5</p></article><p>$1</p></form></body>",
    "<body><div class=menu-page><article data-y=1><h2>T</h2><p>$3</p></article></div><div class=share-page><p>$1</p></div></body>",
    "<body><div class=modal><article data-y=1><p>$1</p><p>$3</p><aside data-y=0><p>$2</p></aside></article></div></body>",
    "<body><div class=comments><article><p>$5</p></article><article><p>$3</p></article></div></body>",
    "<body><div hidden><article><p>$5</p></article></div><div class=ads><article><p>$4</p></article></div></body>",
    # words with another meaning inside the text
    "<article data-y=1><p>$4</p><p class=related-work>$4</p><section id=discussion><h2>Discussion</h2><p>$5</p><p>$2</p></section><p class=follow-up>$1</p></article>",
    "<article data-y=1><p>$3</p><section class=related><h2>Related work</h2><p>$5</p></section><div data-y=0 class=related><h3>Related</h3><ul><li><a href=x>One more</a></li>"
    "<li><a href=x>Another one</a></li></ul></div><div data-y=0 class=tags><a href=x>red</a> <a href=x>blue</a></div></article>",
    "<main data-y=1><section id=discussion><p>$4</p></section><div class=side-notes><p>$4</p></div><div data-y=0 class=recommended><ul><li><a href=x>Read this</a></li></ul></div></main>",
    "<body><div class=related><ul><li><a href=x>One more</a></li></ul></div><article data-y=1><p>$2</p></article><div class=discussion><p>$4</p><p>$3</p></div></body>",
    # boilerplate without marks beside and inside an article
    "<body><main><div><a href=x>Home</a> <a href=x>News</a></div><article data-y=1><h1>T</h1><p>$5</p><p>$4</p><p>$1</p></article><div><p><a href=x>Older entry</a></p></div></main></body>",
    "<body><main><ul><li><a href=x>Start</a></li><li><a href=x>Topics</a></li></ul><article data-y=1><h2>T</h2><p>$4</p><ul><li>$1</li></ul></article><div>$1</div></main></body>",
    "<body><article data-y=1><p>$5</p><p>$4</p><div data-y=0><div><a href=x>Send</a></div><div><a href=x>Print</a></div><div><a href=x>Save this</a></div></div></article></body>",
    "<body><article data-y=1><h1>T</h1><p>$5</p><ul data-y=0><li><a href=x>Older entry</a></li><li><a href=x>Newer entry</a></li><li><a href=x>All of them</a></li></ul></article></body>",
    "<body><main data-y=1><h1>$1</h1><p>$4</p><div data-y=0><ul><li><a href=x>Previous</a></li><li><a href=x>Following</a></li></ul></div></main></body>",
))


@dataclass
class Page:
    """Block elements in document order and the blocks of text in them."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[int] = field(default_factory=lambda: [0])
    mark: list[int] = field(default_factory=lambda: [0])  # group of the element's own mark
    opener: list[int] = field(default_factory=lambda: [0])  # opens an article
    inside: list[int] = field(default_factory=lambda: [0])  # under an opener, itself included
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [0])
    labelled: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _names(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(group of the element's own mark, whether a name of it tells of main text, hand label)."""
    mark = _TAG_MARK.get(tag, 0)
    if not attributes.strip():
        return mark, False, ""
    own = _attributes(attributes)
    names = f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".lower().split()
    # "has-sidebar" or "no-comments" tell of something else on the page
    words = [w for name in names if not re.match("(has|with|without|no)[-_]", name) for w in _WORDS.findall(name)]
    if tag in ("html", "body"):
        return mark, False, own.get("data-y", "")
    found = [_WORD_MARK[w] for w in words if w in _WORD_MARK]
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        found.append(_MARK_ID["hidden"])
    # the group that stands first in the list; a tag's own group only where no name tells more
    return min(found, default=mark), not _MAIN_WORDS.isdisjoint(words), own.get("data-y", "")


_WRAPPERS = {_TAG_ID[t] for t in ("div", "section", "other")}
_UNSHOWN = (_MARK_ID["hidden"], _MARK_ID["ad"])


def parse(html: str) -> Page:
    """The block elements of a page, as a browser would nest them, roughly:
    unclosed paragraphs and items end where the next begins, inline elements
    are transparent, unknown end tags only end a block."""
    page, stack = Page(), [(0, "root")]  # (node, tag)
    text: list[str] = []
    links = size = 0
    in_link = 0
    under_mark = [False]
    in_math = False  # formulas are inline text, whatever their elements
    boiler_inline: list[str] = []

    def flush() -> None:
        nonlocal links, size
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                node = stack[-1][0]
                page.blocks.append((node, joined))
                page.length[node] += len(joined)
                page.link[node] += round(len(joined) * links / max(size, 1))
            text.clear()
            links = size = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at and not boiler_inline:
            piece = html[at:end]
            if not m and (cut := re.search(r"<[a-zA-Z/!][^<]*\Z", piece)):
                piece = piece[: cut.start()]  # a tag that the page breaks off in
            if "&" in piece:
                piece = unescape(piece)
            text.append(piece)
            shown = len(piece) - piece.count(" ")
            size += shown
            links += shown if in_link else 0
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, tag, attributes = bool(m[1] or m[4]), name.lower(), m[3] or m[6] or ""
        if tag == "math":
            in_math = not closing and not attributes.endswith("/")
            continue
        if in_math and not closing and tag not in _BLOCKS:
            continue
        if closing:
            if in_math and tag not in _BLOCKS:
                continue
            if tag == "a":
                in_link = 0
            if tag in _INLINE:
                if boiler_inline and tag == boiler_inline[-1]:
                    boiler_inline.pop()
                if tag in ("td", "th"):
                    text.append(" ")
                continue
            flush()
            boiler_inline.clear()
            in_link = 0
            if any(t == tag for _, t in stack[1:]):
                while stack.pop()[1] != tag:
                    pass
            continue
        if tag in _SKIPPED and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else n if tag in _RAW else at
            continue
        if tag in _VOID:
            if tag in ("br", "wbr", "img", "input"):
                text.append(" " if tag != "wbr" else "")
                continue
            if tag != "hr":
                continue
        if tag in _INLINE:
            if tag in ("td", "th"):
                text.append(" ")
            if tag == "a":
                in_link = 1
            if boiler_inline:
                if tag == boiler_inline[-1]:
                    boiler_inline.append(tag)
            elif attributes and tag != "a" and _names(tag, attributes)[0] in _UNSHOWN:
                boiler_inline.append(tag)  # e.g. a hidden span; no block, so no node of its own
            continue
        flush()
        in_link = 0
        in_math = False
        boiler_inline.clear()
        if tag in _CLOSES_P and stack[-1][1] == "p":
            stack.pop()
        if tag == "hr":
            continue
        if tag in _SIBLINGS:
            rivals = _SIBLINGS[tag].split()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] in rivals:
                    del stack[k:]
                    break
                if stack[k][1] in _SCOPES:
                    break
        parent = stack[-1][0]
        mark, main, label = _names(tag, attributes)
        if tag == "header" and not mark and not page.inside[parent]:
            mark = _MARK_ID["head"]
        # names alone do not open an article under a mark; the elements do
        opens = tag in _OPENERS and not mark or main and not mark and not under_mark[parent]
        stack.append((len(page.parent), tag))
        under_mark.append(bool(mark) or under_mark[parent])
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1)
        page.tag.append(_TAG_ID.get(tag, len(TAGS) - 1))
        page.mark.append(mark)
        page.opener.append(int(opens))
        page.inside.append(int(opens or page.inside[parent]))
        page.length.append(0)
        page.link.append(0)
        page.labelled.append(int(label) if label in ("0", "1") else page.labelled[parent])
    flush()
    return without_wrappers(page)


def without_wrappers(page: Page) -> Page:
    """The page without plain divisions that hold one element and nothing else:
    they say nothing, and would thin out what their surroundings tell."""
    n = len(page.parent)
    children = [0] * n
    for p in page.parent[1:]:
        children[p] += 1
    place, out = [0] * n, Page()
    for i in range(1, n):
        above = place[page.parent[i]]
        if children[i] == 1 and not page.length[i] and not page.mark[i] and not page.opener[i] and page.tag[i] in _WRAPPERS:
            place[i] = above
            continue
        place[i] = len(out.parent)
        out.parent.append(above)
        out.depth.append(out.depth[above] + 1)
        for name in ("tag", "mark", "opener", "inside", "length", "link", "labelled"):
            getattr(out, name).append(getattr(page, name)[i])
    out.length[0], out.link[0] = page.length[0], page.link[0]
    out.blocks = [(place[node], text) for node, text in page.blocks]
    return out


def without_marks(page: Page) -> Page | None:
    """The page as a training page: labelled content where it marks an article,
    and without the marks that say so. None for a page whose article holds marked
    elements or lies in one, as its label is not certain, and for one without."""
    under = [0] * len(page.parent)
    for i in range(1, len(page.parent)):
        under[i] = page.mark[i] or under[page.parent[i]]
        if under[i] and page.inside[i]:
            return None
    if not any(page.opener):
        return None
    none = [0] * len(page.parent)
    opened = {_TAG_ID["article"], _TAG_ID["main"]}
    return replace(page, opener=none, inside=none, labelled=page.inside, tag=[_TAG_ID["div"] if t in opened else t for t in page.tag])


def features(page: Page) -> np.ndarray:
    """(node x slot) feature values, as places in the weights."""
    parent, mark, n = page.parent, page.mark, len(page.parent)
    below, linked, clean = page.length[:], page.link[:], [a - b for a, b in zip(page.length, page.link)]
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
        linked[parent[i]] += linked[i]
        if not mark[i]:
            clean[parent[i]] += clean[i]
    nearest = [0] * n
    for i in range(1, n):
        nearest[i] = mark[i] or nearest[parent[i]]
    # the chief article: the one with most plain text, those outside of marked elements first
    openers = [i for i in range(n) if page.opener[i]]
    chief = max(openers, key=lambda i: (not nearest[i], clean[i], -i), default=-1)
    outer = nearest[chief] if chief >= 0 else 0
    place, around = [OUTSIDE] * n, nearest[:]
    inner = -1
    for i in range(max(chief, 1), n):
        if i == chief:
            place[i], around[i] = CHIEF, 0
        elif place[parent[i]] == CHIEF:
            place[i], around[i] = CHIEF, mark[i] or around[parent[i]]
            if page.tag[i] == _TAG_ID["article"] and not around[i] and 2 * clean[i] >= clean[chief] and inner < 0:
                inner = i
    if inner >= 0:  # what stands beside the article inside the chief one, e.g. in <main>
        path, at = set(), inner
        while at != chief:
            path.add(at)
            at = parent[at]
        within = [False] * n
        for i in range(chief + 1, n):
            within[i] = i == inner or within[parent[i]]
            if place[i] == CHIEF and not within[i] and i not in path:
                place[i] = BESIDE
    for i in range(1, n):
        if place[i] == OUTSIDE and (page.opener[i] or place[parent[i]] == OTHER):
            place[i] = OTHER
    above = np.maximum(np.array(parent), 0)
    below_, linked_ = np.array(below), np.array(linked)

    def shape(length, link, steps):
        return np.searchsorted(steps, length, "right") * (len(_LINKS) + 1) + np.searchsorted(_LINKS, link / np.maximum(length, 1), "right")

    own = shape(np.array(page.length), np.array(page.link), _LENGTHS)
    subtree = shape(below_, linked_, _AROUND)
    stand = np.array(place) * len(MARKS) + np.array(around)
    outers = np.where(np.isin(place, (CHIEF, BESIDE)), outer, 0)
    return np.stack([np.array(page.tag), own, np.array(mark), stand, outers, subtree, subtree[above]], 1) + _FIRST[:-1]


@dataclass
class Nodes:
    """The nodes of many pages side by side; parents stand before children."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray  # for the pair potential with the parent
    features: np.ndarray  # node x slot
    labels: np.ndarray

    def levels(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.searchsorted(self.depth[order], np.arange(1, self.depth.max(initial=0) + 1)))


def side_by_side(pages: list[Page]) -> tuple[Nodes, np.ndarray]:
    first = np.cumsum([0, *(len(p.parent) for p in pages)])[:-1]
    parent = np.concatenate([np.where((a := np.array(p.parent)) < 0, -1, a + f) for p, f in zip(pages, first)])
    depth, mark, opener, labels = (np.concatenate([np.array(getattr(p, k), np.int64) for p in pages]) for k in ("depth", "mark", "opener", "labelled"))
    kind = np.where(opener > 0, 2, mark > 0)
    return Nodes(parent, depth, kind, np.concatenate([features(p) for p in pages]), labels), first


@dataclass(frozen=True)
class TreeModel:
    """Weights of the feature values (towards content) and log potentials of
    parent-child pairs: (kind of the child, parent's label, label)."""

    node: np.ndarray
    pair: np.ndarray

    @staticmethod
    def fit(nodes: Nodes, weight: np.ndarray, steps: int = 300, ridge: float = 0.02) -> "TreeModel":
        """The greatest conditional likelihood of the labels, each node's page
        counting ``weight``, less a ridge penalty; Adam's steps, falling in size."""
        model = TreeModel(np.zeros(FEATURES), np.zeros((KINDS, 2, 2)))
        kids = np.flatnonzero(nodes.parent >= 0)
        cell = nodes.kind[kids] * 4 + 2 * nodes.labels[nodes.parent[kids]] + nodes.labels[kids]
        flat, levels = nodes.features.ravel(), nodes.levels()
        want_pairs = np.bincount(cell, weight[kids], KINDS * 4)
        x = np.zeros(FEATURES + KINDS * 4)
        mean, square = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, steps + 1):
            content, pairs = model.messages(nodes, levels, kids)
            gap = weight * (nodes.labels - content)
            up_node = np.bincount(flat, np.repeat(gap, nodes.features.shape[1]), FEATURES)
            seen = np.zeros((KINDS, 2, 2))
            np.add.at(seen, nodes.kind[kids], weight[kids, None, None] * pairs)
            gradient = np.concatenate([up_node, want_pairs - seen.ravel()]) - ridge * x
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
            x = x + 0.15 * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            model = TreeModel(x[:FEATURES], x[FEATURES:].reshape(KINDS, 2, 2))
        return model

    def potentials(self, nodes: Nodes) -> np.ndarray:
        return np.stack([np.zeros(len(nodes.parent)), self.node[nodes.features].sum(1)], 1)

    def messages(self, nodes: Nodes, levels: list[np.ndarray], kids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of every node, by messages up and then down the trees, and
        for the nodes ``kids`` P(parent's label, label)."""
        up, pair = self.potentials(nodes), self.pair[nodes.kind]
        sent, rest, down = np.zeros((len(up), 2)), np.zeros((len(up), 2)), np.zeros((len(up), 2))
        for level in reversed(levels[1:]):
            sent[level] = np.logaddexp(pair[level, :, 0] + up[level, None, 0], pair[level, :, 1] + up[level, None, 1])
            np.add.at(up, nodes.parent[level], sent[level])
        for level in levels[1:]:
            above = nodes.parent[level]
            rest[level] = down[above] + up[above] - sent[level]
            r = rest[level]
            down[level] = np.logaddexp(r[:, 0, None] + pair[level, 0, :], r[:, 1, None] + pair[level, 1, :])
        both = up + down
        content = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        if kids is None:
            return content, np.zeros((0, 2, 2))
        joint = rest[kids][:, :, None] + pair[kids] + up[kids][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        return content, joint / joint.sum((1, 2), keepdims=True)

    def marginals(self, nodes: Nodes) -> np.ndarray:
        return self.messages(nodes, nodes.levels())[0]


def fit_pages(sampled: list[Page]) -> TreeModel:
    """Weights from the hand-labelled pages and sampled ones; the sampled pages
    together count at most as much as those labelled by hand."""
    hand = [parse(h) for h in LABELLED]
    nodes, _ = side_by_side(hand + sampled)
    each = [1.0] * len(hand) + [min(1.0, len(hand) / max(len(sampled), 1))] * len(sampled)
    return TreeModel.fit(nodes, np.repeat(each, [len(p.parent) for p in hand + sampled]))


_SENT = ("parent", "depth", "tag", "mark", "opener", "length", "link", "labelled")


def train(pages: DataFrame, html_col: str = "html", train_pages: int = 400, train_nodes: int = 500) -> TreeModel:
    """The model of the hand-labelled pages and of at most ``train_pages`` distinct
    pages that mark their article (those with the smallest hashes, of at most
    ``train_nodes`` block elements); copies count once. What reaches the driver is
    eight numbers a node of these pages, no text."""
    ship(pages.sparkSession)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, found = [], []
            for k, h in zip(b.column("page").to_pylist(), b.column("html")):
                page = without_marks(parse(h.as_py()))
                if page is not None and len(page.parent) <= train_nodes:
                    kept.append(k)
                    found.append([getattr(page, name) for name in _SENT])
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int64())))], ["page", "tree"])

    html = F.col(html_col)
    marked = pages.select(html.alias("html")).where(html.rlike("(?i)<(article|main)[ >]")).withColumn("page", F.xxhash64("html"))
    # thinned out as distinct hashes, so that groups of copies neither fill nor empty the sample
    taken = smallest_hashes(marked.select("page").distinct(), train_pages, "page")
    marked = marked.join(F.broadcast(taken), "page", "left_semi").groupBy("page").agg(F.min("html").alias("html"))
    rows = marked.mapInArrow(trees, "page bigint, tree array<array<bigint>>").collect()
    return fit_pages([Page(**dict(zip(_SENT, r["tree"]))) for r in sorted(rows, key=lambda r: r["page"])])


def main_texts(model: TreeModel, htmls: list[str]) -> list[str]:
    """Main text of each page; blocks joined by one newline."""
    if not htmls:
        return []
    pages = [parse(h) for h in htmls]
    nodes, first = side_by_side(pages)
    content = model.marginals(nodes) > 0.5
    return ["\n".join(text for node, text in p.blocks if content[f + node]) for p, f in zip(pages, first)]


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", html_col: str = "html",
            carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``<id_col>, <carry>, text, n_chars`` of every row's whole html.

    Null and empty html give an empty text, and so do pages without content.
    Repeated rows and null ids are extracted like any other; other columns are
    ignored.
    """
    ship(pages.sparkSession)
    kept = [f for c in (id_col, *carry) for f in pages.schema.fields if f.name == c]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            for at in range(0, b.num_rows, 256):
                texts += main_texts(model, [h.as_py() or "" for h in b.column("__html").slice(at, 256)])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*(f.name for f in kept), "text", "n_chars"])

    return (pages.select(*(F.col(f.name) for f in kept), F.col(html_col).alias("__html"))
            .mapInArrow(run, f"{schema}, text string, n_chars bigint"))


def op4_dom_marginals(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages))
