"""HTML extraction: flat text blocks, classified by a decision tree over their own and their neighbours' word counts and link densities.

A page is cut at block-level tags into flat blocks of text.  Each block has its words, the share of them inside links, the
same of the blocks before and after it, its kind of tag, and the zone of its innermost containers: a page's own markup
(nav, footer, aside, form, article, main, roles, and words in class and id) says where a block stands.  A decision tree,
grown here from a small table of labelled blocks (LABELLED, or any other given as a parameter), keeps or drops each block.
Pages are independent rows, so nothing is shuffled.

Defined cases: null or empty html gives an empty text; text outside of all tags is a block; unclosed comments, scripts and
styles reach to the end of the page, as in browsers; `br` is white space; repeated rows give repeated results; pages of any
length are taken whole, in time linear in the length for every open tag; columns other than the id, url and html are passed
over, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- flat blocks --------------------------------------------------------------------------------------------------

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)  # fmt: skip
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|style|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button label object svg canvas datalist audio video map math output".split()
)
#: Opening one of these ends an open element of the same set up to the nearest list or table.
SIBLINGS = {t: frozenset(g.split()) for g in ("li", "dt dd", "td th", "tr", "option", "thead tbody tfoot") for t in g.split()}
_SCOPE = frozenset("ul ol menu dir dl table select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Zones: what a container says of the text in it.  STUCK ones hold for all that is inside, the others until an article begins.
LOOSE = frozenset("nav header form fieldset label legend".split())
STUCK = frozenset("footer aside menu dialog button select option optgroup datalist object svg canvas audio video map head".split())
OPEN = frozenset("article main".split())
LOOSE_WORDS = frozenset("nav navbar topnav subnav navigation menu menus header masthead topbar toolbar banner form search login signin signup register breadcrumb breadcrumbs pagination pager".split())
STUCK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion cookie cookies consent gdpr notice notices alert alerts popup "
    "modal overlay newsletter subscribe subscription paywall share sharing social related recommended recommendations trending teaser teasers sidebar aside widget widgets footer comment comments "
    "reply replies respond disqus discussion copyright legal disclaimer skip tags tagcloud byline meta hidden invisible outbrain taboola feedback ugc pingback pingbacks notification notifications toast donate announcement ticker poll survey rail side sitemap adbox adslot adunit adbanner adcontainer colophon".split()
)
OPEN_WORDS = frozenset("article content post entry story main maincontent articlebody bodytext blogpost".split())
LOOSE_ROLES, STUCK_ROLES = frozenset("navigation banner search form menu menubar toolbar".split()), frozenset("contentinfo complementary dialog alertdialog alert tooltip".split())
_UNLESS = frozenset("has with no without js is".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: int
    kind: str  # h heading, l list item or cell, p anything else


def _zone(name: str, attributes: str, zone: int, stuck: bool) -> tuple[int, bool]:
    """Zone and stickiness inside an element, from those around it."""
    if stuck:
        return -1, True
    said = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
    words: list[str] = []
    if name not in ("html", "body"):
        for value in (said.get("class", ""), said.get("id", "")):
            for token in value.split():
                parts = [w.lower() for w in _WORDS.findall(token)]
                words += [] if parts and parts[0] in _UNLESS else parts
    role = said.get("role", "").lower()
    hidden = "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", ""), re.I)
    if name in STUCK or hidden or role in STUCK_ROLES or not STUCK_WORDS.isdisjoint(words):
        return -1, True
    opens = name in OPEN or role in OPEN or "articlebody" in said.get("itemprop", "").lower()
    if name in LOOSE or role in LOOSE_ROLES or (not opens and not LOOSE_WORDS.isdisjoint(words)):
        # an article's own header holds its title
        return (1 if zone == 1 and (name == "header" or "header" in words) else -1), False
    if opens or (zone == 0 and not OPEN_WORDS.isdisjoint(words)):
        return 1, False
    return zone, False


def flat_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with white space and character references resolved."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    opened: Counter[str] = Counter()
    link_depth = -1

    def flush() -> None:
        if parts:
            text = entities.unescape("".join(parts)).split()
            if text:
                linked = len(entities.unescape(" ".join(links)).split()) if links else 0
                zone = stack[-1][1] if stack else 0
                names = {s[0] for s in stack[-3:]}
                kind = "h" if names & HEADINGS else "l" if names & {"li", "td", "th", "dt", "dd", "option", "tr"} else "p"
                out.append(Block(" ".join(text), len(text), min(linked, len(text)), zone, kind))
            parts.clear()
            links.clear()

    def pop_to(at: int) -> None:
        nonlocal link_depth
        opened.subtract(s[0] for s in stack[at:])
        del stack[at:]
        if link_depth > len(stack):
            link_depth = -1

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        found = _TAG.match(page, lt) if lt >= 0 else None
        stop = end if lt < 0 else lt if found else lt + 1
        if stop > at:
            parts.append(page[at:stop])
            if link_depth >= 0:
                links.append(page[at:stop])
        if lt < 0:
            break
        at = found.end() if found else stop
        if not found or not found["name"]:
            continue
        name, closes = found["name"].lower(), bool(found["close"])
        if name in RAW and not closes:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link_depth = -1 if closes else len(stack)
        elif name in BLOCKS:
            flush()
            if closes:
                for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                    if stack[depth][0] == name:
                        pop_to(depth)
                        break
            else:
                if stack and stack[-1][0] == "p":
                    pop_to(len(stack) - 1)
                if name in SIBLINGS and any(opened[s] for s in SIBLINGS[name]):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in SIBLINGS[name]:
                            pop_to(depth)
                            break
                        if stack[depth][0] in _SCOPE:
                            break
                if name not in VOID:
                    around = stack[-1][1:] if stack else (0, False)
                    stack.append((name, *_zone(name, found["attributes"], *around)))
                    opened[name] += 1
    flush()
    return out


# --- features and the tree ----------------------------------------------------------------------------------------

FEATURES = ("zone", "page_has_article", "words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "list")


def features(words: np.ndarray, linked: np.ndarray, zones: np.ndarray, kinds: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """One row for each block; neighbours are of the same page and the same zone's side."""
    n = len(words)
    x = np.zeros((n, len(FEATURES)))
    density = linked / np.maximum(words, 1)
    with_article = np.bincount(pages, zones > 0, int(pages.max(initial=-1)) + 1) > 0
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = zones, with_article[pages], words, density
    same = pages[1:] == pages[:-1]
    x[1:, 4], x[1:, 5] = np.where(same, words[:-1], 0), np.where(same, density[:-1], 0)
    x[:-1, 6], x[:-1, 7] = np.where(same, words[1:], 0), np.where(same, density[1:], 0)
    x[:, 8], x[:, 9] = kinds == "h", kinds == "l"
    return x


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keep: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(x):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            go = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return self.keep[at] if len(x) else np.zeros(0, bool)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1) -> Tree:
    """A tree of axis-parallel cuts that lower the Gini impurity most; ties go to the earlier feature and the lower cut."""
    nodes: list[list] = []

    def gini(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 2 * pos * (n - pos) / np.maximum(n, 1)

    def split(rows: np.ndarray, left: int) -> int:
        at, labels = len(nodes), y[rows]
        nodes.append([-1, 0.0, -1, -1, 2 * labels.sum() >= len(rows)])
        best = (float(gini(labels.sum(), np.array(len(rows)))) - 1e-9, -1, 0.0)
        if left and 0 < labels.sum() < len(rows):
            for f in range(x.shape[1]):
                by = np.argsort(x[rows, f], kind="stable")
                value, pos = x[rows, f][by], np.cumsum(labels[by])
                cut = np.flatnonzero(value[1:] > value[:-1])
                cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
                if not len(cut):
                    continue
                total = gini(pos[cut], cut + 1) + gini(pos[-1] - pos[cut], len(rows) - cut - 1)
                k = int(total.argmin())
                if total[k] < best[0] - 1e-9:
                    best = (float(total[k]), f, float(value[cut[k]] + value[cut[k] + 1]) / 2)
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1:]
            nodes[at][2] = split(rows[low], left - 1)
            nodes[at][3] = split(rows[~low], left - 1)
        return at

    split(np.arange(len(y)), depth)
    return Tree(*(np.array(part, kind) for part, kind in zip(zip(*nodes), (np.int64, float, np.int64, np.int64, bool))))


#: The labelled table: a page a line, a block a token: zone (+ article, - page furniture, . neither), kind (h, l, p), words, linked words
#: behind a slash, and ! on blocks of the main text.
LABELLED = """
-l1/1 -l1/1 -l2/2 -l1/1 -p9 +h8! +p1! +p60! +p3! +p90/2! +p2! -p9
-p4 -l1/1 -l2/2 +h5! +p30! +p12! +p200/5! +l6! +l9! +l12/3! +p40! -p30 -p12/1 -p5/1
+p3! +p1! +p1! +p7! +p400! +p1! -p14
-l3/3 +h4! +p20/1! +h3! +p35! +h2! +p80! +l4! +l2! +l7! +p5! -p60 -p45
-p12 -p80 +h6! +p11! +p25! +l30/2! +l5! +l3! +p18/18! +p44! -p33 -p16/8
-h2 -l2/2 -l3/3 -h3 +h9! +p55/4! +p70! -h2 -p22 -p31 -p28 -p4/4
+h7! +p100! +p90/12! +p1! +l5/5 +l7/7 +l6/6 +l4/4 -p7/3
+h3! +p15! +l2/2 +l3/3 +l2/2 +l4/4 +p50! +p60! -p5
+p8/8! +p30/9! +p40! +h5/5! +p33! +p10/10! +p21! -l1/1 -l1/1
.l1/1 .l1/1 .l2/2 .l1/1 .h7! .p64! .p80/3! .p6! .p90! .p3/2 .p12/6 .l2/2 .l3/3
.p3/3 .p8/7 .h5! .p40! .p15! .p33! .h3! .p70! .l12! .l20! .p52! .p9/4 .p4/4 .p6/5
.p6 .l2/2 .l2/2 .p40! .p50! .p4! .p60! .p45! .p7/7 .p3/3
.h2 .l3/3 .l4/4 .l5/5 .h2 .l3/3 .l2/2 .p30! .p45! .p2 .l1/1
.p2/2 .p1/1 .p1/1 .h4! .p25! .p28! .p31! .p5/5 .p11/9
.p250! .p1 .p4/4
.p18! .p22! .p90!
.h6! .p3! .p10! .p60!
.p12!
.h3! .p8!
.p9! .p7! .p11!
.p5 .p7 +h6! +p40! +p70! .p12 .p8/2 .p30
.l1/1 .p14 .h3 +p50! +p8! +p4! .p25 .h3 .l4/4 .l6/6 .p90
.p60 .p5/5 +p30! +p2! +p120! .p45 .p20/3
.h4 .p6 -p8 -l2/2 +h8! +p33! +l8! +l9! .p11 -p40 -p70
-p20 -p35 -p8/1 -l2/2 -l1/1
-l1/1 -l2/2 .p70! .p66! -p50 -p90 .p30! -p6
.p3/3 .h4! .p25! .p2! .p30! .p1! .p40! .p2/2 .p4
.p5/4 .h3! .p40! .p2! .p35! .p22! .p3/2 .p5
.l1/1 .l1/1 .p50! .p1! .p2! .p60! .l2/2 .l2/2 .p6
.h2! .p45! .h2! .p70! .h1! .p30! .p9/7 .p3
-p300 -p7 -h3 .h5! .p80! .p6! .p40! -p120 -p64 -h2 -p15
"""


def labelled_blocks(table: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a table in the form of LABELLED."""
    found = [(page, re.fullmatch(r"([+.-])([hlp])(\d+)(?:/(\d+))?(!?)", token)) for page, line in enumerate(table.strip().splitlines()) for token in line.split()]
    zone = np.array([{"+": 1, ".": 0, "-": -1}[m[1]] for _, m in found])
    words, linked = np.array([int(m[3]) for _, m in found]), np.array([int(m[4] or 0) for _, m in found])
    return features(words, linked, zone, np.array([m[2] for _, m in found]), np.array([p for p, _ in found])), np.array([m[5] == "!" for _, m in found])


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The kept blocks of each page, one a line."""
    cut = [flat_blocks(p) if p else [] for p in pages]
    flat = [b for blocks in cut for b in blocks]
    if not flat:
        return [""] * len(pages)
    at = np.repeat(np.arange(len(cut)), [len(b) for b in cut])
    column = lambda name, kind: np.array([getattr(b, name) for b in flat], kind)
    keep = tree(features(column("words", np.int64), column("linked", np.int64), column("zone", np.int64), column("kind", "U1"), at))
    lines: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero(keep):
        lines[at[k]].append(flat[k].text)
    return ["\n".join(x) for x in lines]


#: Characters of html that are taken apart together, unless one page is longer.
CHUNK = 1 << 21


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", labelled: str = LABELLED, depth: int = 10) -> DataFrame:
    """page_id, url, the main text and its length in code points, for each row."""
    tree = grow(*labelled_blocks(labelled), depth)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size = 0, 0
            lengths = [len(x) if x else 0 for x in batch.column(2).to_pylist()]
            for hi in range(1, batch.num_rows + 1):
                size += lengths[hi - 1]
                if hi == batch.num_rows or size + lengths[hi] > CHUNK:
                    part = batch.slice(lo, hi - lo)
                    texts = main_texts(part.column(2).to_pylist(), tree)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    lo, size = hi, 0

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
