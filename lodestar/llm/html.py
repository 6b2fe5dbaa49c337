"""Main text of web pages: site templates are found by counting element subtrees per host.

Every element of a page has a hash of its whole subtree (names, classes and
text). A subtree that recurs on many pages of a host belongs to the site and
not to the page, so it is deleted: Spark counts, for each host, on how many
different pages a hash occurs, and each page is then read again without the
subtrees whose hashes are in its host's set. What a page's author marks as the
article needs far stronger evidence than what stands around it. On a page
without such a mark, the box that holds most of its text and its main headline
are taken as marked: near copies share their paragraphs, and pages may quote one
passage, so a few recurrences there prove nothing.

A site fills some of its subtrees anew on each page (a menu, an advert), so a
subtree whose name, role, class or id names such a part has a second hash, its
slot: that word without the text. Slots are counted like any other hash, and a
recurring slot is deleted whatever it is filled with. The words alone decide
only what counts can't: what HTML itself sets apart (``NEVER``, ``PARTS``), the
words of ``CERTAIN``, and, outside of articles, all words on a host with fewer
than ``LEAST_PAGES`` different pages.

Only hashes are counted and only hosts' sets are joined with pages. A set is
bounded: a hash has to be on a share of at least ``LEAST_SHARE`` of a host's
pages, so a host has at most 1 / ``LEAST_SHARE`` times the mean number of
subtrees of its pages, and there are two slots for each word.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch, batch, rows

#: A subtree outside the article belongs to the site from this many pages and this share of the host's pages on.
LEAST_PAGES, LEAST_SHARE = 3, 0.05
#: The same for a subtree inside the article.
ARTICLE_PAGES, ARTICLE_SHARE = 20, 0.5
#: A slot belongs to the site from this many pages on; within articles from ``LEAST_PAGES`` and ``ARTICLE_SHARE``.
SLOT_PAGES = 2

# Elements of HTML by what the reader has to know of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template iframe svg canvas object embed audio video map button select option textarea title xmp noembed noframes input".split())
#: Parts of a site by the name of the element; headers only outside of articles, where they hold the headline.
PARTS = frozenset("nav footer aside form dialog menu".split())
HEADERS = frozenset(("header", "hgroup"))
ARTICLE = frozenset(("article", "main"))
#: Elements that a page is laid out with.
BOXES = frozenset("html body div section center table tbody tr td fieldset details".split())
#: An end tag that may be left out: a start tag of the second kind ends an open element of the first.
IMPLIED = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
}
ENDERS = frozenset().union(*IMPLIED.values())
ENDED = frozenset((*IMPLIED, "p"))
LISTS = frozenset("ul ol dl table select".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that an end tag further out doesn't close through.
SCOPE = frozenset("table td th html body article section main".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
CLASSES = frozenset(
    """ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner sidebar rail menu nav navbar navigation
    breadcrumb breadcrumbs topbar masthead footer cookie cookies consent gdpr notice notification alert popup modal overlay comment comments
    reply replies disqus respond newsletter subscribe subscription signup share sharing social related recommended recommendations
    widget toolbar pagination pager login search skip""".split()
)
#: Of these, those that mean a part of the site wherever they stand.
CERTAIN = frozenset(
    """ad ads adv advert advertisement advertising adsense sponsored banner sidebar navbar breadcrumb breadcrumbs topbar masthead
    footer cookie cookies consent gdpr popup comment comments disqus respond newsletter pagination""".split()
)

#: All words that slots are of.
WORDS = frozenset({*CLASSES, "header", *(f"role={x}" for x in ROLES), *(f"<{x}>" for x in (*PARTS, *HEADERS))})

#: A whole tag. Each part is possessive, so a text that isn't a tag is given up after one look.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME_ENDS = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_ZEROS = re.compile(r"(&#[xX])0{8,}(?=[0-9a-fA-F])|(&#)0{8,}(?=[0-9])")
_NO_CHARACTER = re.compile(r"&#(?:[1-9][0-9]{7}[0-9]*|[xX][1-9a-fA-F][0-9a-fA-F]{6}[0-9a-fA-F]*);?")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Node:
    """An element; children are nodes, and texts as strings."""

    name: str
    marks: str = ""
    words: tuple[str, ...] = ()
    dropped: bool = False
    article: bool = False
    told: bool = False
    inside: bool = False
    parent: Node | None = None
    children: list = field(default_factory=list)
    digest: int = 0
    #: Characters of its own texts, of all below, and of those that stay.
    own: int = 0
    size: int = 0
    live: int = 0
    holds: bool = False
    headed: bool = False
    body: bool = False


def _marks(attributes: str) -> tuple[str, tuple[str, ...], bool]:
    """Class and id of a start tag, the words in them or its role that tell of a part of the site, and if it is hidden."""
    marks, role, hidden = "", "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            marks += " " + value.lower()
        elif name == "role":
            role = value.lower()
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    words = tuple(dict.fromkeys(w for w in marks.split() if w in CLASSES))
    return marks, (*words, f"role={role}") if role in ROLES else words, hidden


class _Open(list):
    """The open elements, with what is needed to tell at once that an end tag has no partner.

    ``names`` counts all open elements; ``lines`` the inline ones since each
    element that isn't, and ``walls`` those whose ends may be implied since each
    element that such ends don't reach out of. Walking down the open elements always ends in
    closing them, so the work is in proportion to the tags.
    """

    def __init__(self, root: Node):
        super().__init__([root])
        self.names: Counter[str] = Counter()
        self.lines: list[list] = [[0, None]]
        self.walls: list[tuple[int, Counter[str]]] = [(0, Counter())]

    def push(self, node: Node) -> None:
        name = node.name
        if name in INLINE:
            line = self.lines[-1]
            line[1] = line[1] or Counter()
            line[1][name] += 1
        else:
            self.lines.append([len(self), None])
            if name in LISTS or name in SCOPE:
                self.walls.append((len(self), Counter()))
            if name in ENDED:
                self.walls[-1][1][name] += 1
        self.append(node)
        self.names[name] += 1

    def cut(self, n: int) -> None:
        """Close the element at ``n`` and all within it."""
        while len(self) > n:
            name = self.pop().name
            self.names[name] -= 1
            if name in INLINE:
                self.lines[-1][1][name] -= 1
                continue
            self.lines.pop()
            if name in ENDED:
                self.walls[-1][1][name] -= 1
            if self.walls[-1][0] == len(self):
                self.walls.pop()

    def last(self, names) -> None:
        """Close the innermost element of ``names``, which there is."""
        n = len(self) - 1
        while self[n].name not in names:
            n -= 1
        self.cut(n)

    def close(self, name: str) -> None:
        """An end tag; an inline one doesn't reach out of its block, nor that of a paragraph out of a list or table."""
        reach = self.lines[-1][1] if name in INLINE else self.walls[-1][1] if name == "p" else self.names
        if reach and reach[name]:
            self.last((name,))

    def imply(self, name: str) -> None:
        """The ends of elements that the start of ``name`` brings."""
        if name in ENDS_P and self[self.lines[-1][0]].name == "p":
            self.cut(self.lines[-1][0])
        if name in ENDERS:
            ended = [x for x, by in IMPLIED.items() if name in by and self.walls[-1][1][x]]
            if ended:
                self.last(ended)


class _Tags:
    """Where tags end: by one pattern, and once that has failed by a table of all quotes and ends, made in one pass."""

    def __init__(self, page: str):
        self.page = page
        self.specials: list[int] = []
        self.ends: list[int] | None = None
        self.name_end = -1

    def at(self, start: int) -> tuple[bool, str, str, int] | None:
        """Whether it is an end tag, name, attributes and end of the tag at ``start``; None if there is none."""
        if self.ends is None and (m := _TAG.match(self.page, start)):
            return bool(m[1]), m[2].lower(), m[3], m.end()
        name = start + 1 + self.page.startswith("/", start + 1)
        first = self.page[name : name + 1]
        if not (first.isascii() and first.isalpha()):
            return None
        if self.ends is None:
            self._table()
        if self.name_end < name:
            m = _NAME_ENDS.search(self.page, name)
            self.name_end = m.start() if m else len(self.page)
        end = self.ends[bisect_left(self.specials, self.name_end)]
        if end < 0:
            return None
        return name > start + 1, self.page[name : self.name_end].lower(), self.page[self.name_end : end], end + 1

    def _table(self) -> None:
        """For each quote and ``>`` the end of a tag that is open there outside of quotes, worked out from the last to the first."""
        self.specials = [m.start() for m in _SPECIAL.finditer(self.page)]
        self.ends = [-1] * (len(self.specials) + 1)
        following: dict[str, int] = {}
        for k in range(len(self.specials) - 1, -1, -1):
            c = self.page[self.specials[k]]
            if c == ">":
                self.ends[k] = self.specials[k]
                continue
            if c in following:
                self.ends[k] = self.ends[following[c] + 1]
            following[c] = k


def parse(page: str) -> Node:
    """The tree of a page, tolerant of markup that isn't closed, in time in proportion to its length.

    A ``<`` that doesn't start a tag with an end is text.
    """
    root = Node("#root")
    opened, tags = _Open(root), _Tags(page)
    at, look, size = 0, 0, len(page)
    last = page.rfind(">")
    while at < size:
        start = page.find("<", look)
        if start < 0 or start > last and not page.startswith(("<!--", "<![CDATA["), start):
            # Nothing ends from here on; only a comment or a section may still begin.
            more = min((x for x in (page.find("<!--", look), page.find("<![CDATA[", look)) if x >= 0), default=-1)
            if start < 0 or more < 0:
                opened[-1].children.append(page[at:])
                break
            start = more
        if page.startswith(("!", "?"), start + 1):
            if start > at:
                opened[-1].children.append(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = look = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                opened[-1].children.append(html.escape(page[start + 9 : end if end >= 0 else size], quote=False))
                at = look = end + 3 if end >= 0 else size
            else:
                at = look = page.find(">", start) + 1
            continue
        tag = tags.at(start)
        if tag is None:
            look = start + 1
            continue
        if start > at:
            opened[-1].children.append(page[at:start])
        closes, name, attributes, end = tag
        at = look = end
        if closes:
            opened.close(name)
            continue
        opened.imply(name)
        node = _element(name, attributes, opened[-1])
        node.parent.children.append(node)
        if name in RAW:
            found = _raw_end(name).search(page, at)
            end = page.find(">", found.end()) if found else -1
            at = look = end + 1 if end >= 0 else size
        elif name not in VOID and not (attributes.endswith("/") and name not in INLINE and name not in ENDS_P):
            opened.push(node)
    return root


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _element(name: str, attributes: str, parent: Node) -> Node:
    inside = parent.inside or parent.article
    marks, words, hidden = _marks(attributes) if attributes else ("", (), False)
    if not inside and "header" in marks.split():
        words = (*words, "header")
    if name in ("html", "body"):
        words = ()
    article = name in ARTICLE or "main" in attributes and re.search(r"role=[\"']?main\b", attributes) is not None
    part = name in PARTS or name in HEADERS and not inside
    never = name in NEVER or hidden
    told = bool(words) and not part and not never
    if part:
        words = (f"<{name}>", *words)
    return Node(name, marks, () if never else words, never or part or told, article and not (never or part or told), told, inside, parent)


def clean(text: str) -> str:
    """References decoded, white space turned into single spaces, trimmed."""
    if "&#" in text:  # numbers of any length, which Python doesn't read
        text = _NO_CHARACTER.sub("\ufffd", _ZEROS.sub(lambda m: m[1] or m[2], text))
    return " ".join(html.unescape(text).split())


def digest(root: Node) -> None:
    """Set hashes, sizes and what holds an article, from the leaves up, without recursion.

    An element that goes by its class stays after all if it holds the page's
    largest article, and so do the elements that go by their classes if they
    hold most of the text of the page or of its articles: then the class speaks of the layout.
    """
    order, queue = [], [root]
    while queue:
        node = queue.pop()
        order.append(node)
        queue += [c for c in node.children if isinstance(c, Node)]
    largest = None
    for node in reversed(order):
        h = xxhash.xxh64(f"{node.name}\0{node.marks}")
        node.holds, node.headed = node.article, node.name == "h1"
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.digest.to_bytes(8, "little"))
                node.size += c.size
                node.holds, node.headed = node.holds or c.holds, node.headed or c.headed
            elif t := clean(c):
                h.update(t)
                h.update(b"\0")
                node.own += len(t)
        node.size += node.own
        node.digest = h.intdigest()
        if node.article and (largest is None or node.size >= largest.size):
            largest = node
    while largest is not None:
        if largest.told:
            largest.dropped = False
        largest = largest.parent
    _keep_most(root, order)
    for node in reversed(order):
        node.live = 0 if node.dropped else node.own + sum(c.live for c in node.children if isinstance(c, Node))
    _mark_body(root)


def _keep_most(root: Node, order: list[Node]) -> None:
    """Keep what goes by its class, the largest first, until what still goes so is at most half of the text.

    Where a page has a marked article with text, this holds within its
    articles: next to one, a class tells of a text of any size.
    """
    if not any(node.told and node.dropped for node in order):
        return
    # Text that stays if classes tell nothing; inner elements come first.
    text: dict[int, int] = {}
    for node in reversed(order):
        text[id(node)] = 0 if node.dropped and not node.told else node.own + sum(text[id(c)] for c in node.children if isinstance(c, Node))
    place = {id(node): n for n, node in enumerate(order)}
    going: list[tuple[int, int, Node]] = []  # largest first

    def fall(queue: list) -> int:
        """What goes by its class below ``queue`` joins ``going``; its text."""
        more = 0
        while queue:
            node = queue.pop()
            if not isinstance(node, Node) or node.dropped and not node.told:
                continue
            if node.dropped:
                heapq.heappush(going, (-text[id(node)], place[id(node)], node))
                more += text[id(node)]
            else:
                queue += node.children
        return more

    articles, queue = [], [root]
    while queue:
        node = queue.pop()
        if node.article:
            articles.append(node)
        elif not node.dropped:
            queue += [c for c in node.children if isinstance(c, Node)]
    starts = articles if any(text[id(x)] for x in articles) else [root]
    total, lost = sum(text[id(x)] for x in starts), fall(list(starts))
    while 2 * lost > total:
        node = heapq.heappop(going)[2]
        node.dropped = False
        lost += fall(list(node.children)) - text[id(node)]


def _blocks(node: Node) -> list[Node]:
    """Children with text to keep that aren't part of a line."""
    return [c for c in node.children if isinstance(c, Node) and c.live and c.name not in INLINE]


def _mark_body(root: Node) -> None:
    """Mark the smallest box that holds most of the page's text, unless it holds or lies in what is marked as the article.

    A single paragraph, or one of several boxes of the same class, isn't the
    body but a part of it.
    """
    node, path = root, []
    while inner := [c for c in _blocks(node) if c.name in BOXES and 2 * c.live > root.live]:
        path.append(node)
        node = inner[0]
    while path and (not _blocks(node) or node.marks and any(c is not node and (c.name, c.marks) == (node.name, node.marks) for c in _blocks(path[-1]))):
        node = path.pop()
    if node.live and not (node.holds or node.inside):
        for x in [*path, node]:
            x.body = True


@cache
def slot(word: str, inside: bool) -> int:
    """The hash of what a word tells to be a part of the site, in an article or not."""
    return xxhash.xxh64_intdigest(f"slot\0{word}\0{inside}")


def subtrees(root: Node) -> tuple[dict[int, bool], set[int]]:
    """Hashes of a page's subtrees that have text of their own to lose, with whether all that have one lie in an article; and its slots.

    What holds most of the text of a page without a marked article, and the
    main headline of such a page, count as its article. Of a part by name only
    the slot is counted, and what holds an article isn't counted, since a
    page's article can't belong to its site's template.
    """
    found: dict[int, bool] = {}
    slots: set[int] = set()
    queue = [(root, False)]
    while queue:
        node, inside = queue.pop()
        # Below the innermost box that is marked as the body, everything is inside.
        inside = inside or node.article or node.body and not any(isinstance(c, Node) and c.body for c in node.children)
        for c in node.children:
            if not isinstance(c, Node):
                continue
            if c.dropped:
                slots.update(slot(w, c.inside) for w in c.words)
                if not c.told:
                    continue
            within = inside or c.headed and not root.holds
            queue.append((c, inside or c.name == "h1" and not root.holds))
            if c.name not in VOID and c.name not in ("html", "body") and not (c.holds or c.body) and c.size:
                found[c.digest] = found.get(c.digest, True) and within
    return found, slots


@dataclass(frozen=True)
class Site:
    """What counts say of a host: hashes to delete outside marked articles, and those to delete everywhere.

    ``counted`` tells that the host has pages enough to count. Without ``aid``
    words and names decide nothing on such a host.
    """

    around: frozenset[int] = frozenset()
    everywhere: frozenset[int] = frozenset()
    counted: bool = False
    aid: bool = True

    def drops(self, node: Node, inside: bool) -> bool:
        """Whether a part of the site goes, by its slot or by its words."""
        if not node.words:
            return True
        if not (self.everywhere if inside else self.around).isdisjoint(slot(w, inside) for w in node.words):
            return True
        if self.counted and not self.aid:
            return False
        return not (inside or self.counted) or any(w in CERTAIN or w[0] == "<" or w.startswith("role=") for w in node.words)


def text_of(root: Node, site: Site = Site()) -> str:  # noqa: B008
    """Text of what remains, block by block."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if t := clean("".join(run)):
                blocks.append(t)
            run.clear()

    queue: list = [(root, False)]
    while queue:
        item, inside = queue.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        elif item.dropped and site.drops(item, inside) or not item.article and (item.digest in site.everywhere or not inside and item.digest in site.around):
            if item.name not in INLINE:
                end()
        elif item.name == "br":
            run.append("\n")
        else:
            if item.name not in INLINE:
                end()
                queue.append((None, inside))
            queue += [(c, inside or item.article) for c in reversed(item.children)]
    end()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased; empty for null and for addresses without one."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """``of_host, of_site, of_article`` of each host with ``LEAST_PAGES`` different pages: the hashes of its template, from rows ``host, html``.

    ``host`` is a hash of the host. A subtree or slot has to be on pages of
    different content: copies of a page don't make its text a template. For
    ``of_site`` only the pages count on which it isn't in an article.
    """
    page, subtree, slot_outside, slot_inside = range(4)
    inner = {slot(w, True) for w in WORDS}

    def count(batches):
        for b in rows(batches, 256):
            hosts, hashes, kinds, inside, contents = [], [], [], [], []
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                digest(root := parse(text))
                found, slots = subtrees(root)
                # The page itself goes in as hash 0, for the number of pages.
                n = 1 + len(found) + len(slots)
                hosts += [host] * n
                hashes += [0, *found, *slots]
                kinds += [page, *[subtree] * len(found), *(slot_inside if x in inner else slot_outside for x in slots)]
                inside += [False, *found.values(), *[False] * len(slots)]
                contents += [xxhash.xxh64_intdigest(text_of(root))] * n
            yield batch(pa.schema([("host", pa.int64()), ("hash", pa.int64()), ("kind", pa.int8()), ("inside", pa.bool_()), ("content", pa.int64())]), hosts, np.array(hashes, np.uint64).view(np.int64), kinds, inside, np.array(contents, np.uint64).view(np.int64))

    seen = pages.where("html is not null").select("host", "html").mapInArrow(count, "host bigint, hash bigint, kind tinyint, inside boolean, content bigint")
    # Copies come together first, over keys as many as there are contents, so that a large host's subtrees are dealt out.
    different = seen.groupBy("host", "hash", "kind", "content").agg(F.bool_and("inside").alias("inside"))
    counted = different.groupBy("host", "hash", "kind").agg(F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("outside"))
    least = F.when(F.col("kind") == slot_outside, SLOT_PAGES).otherwise(LEAST_PAGES)
    stored = Scratch(pages.sparkSession, "templates").write(counted.where(F.col("n") >= least), "counts")
    sizes = stored.where(F.col("kind") == page).select(F.col("host").alias("of_host"), F.col("n").alias("pages"))
    often = sizes.join(stored.where(F.col("kind") != page), F.col("host") == F.col("of_host"), "left")
    share = lambda count, part: F.col(count) >= F.col("pages") * part
    around = F.when(F.col("kind") == subtree, (F.col("outside") >= LEAST_PAGES) & share("outside", LEAST_SHARE)).otherwise(F.col("kind") == slot_outside)
    everywhere = F.when(F.col("kind") == subtree, (F.col("n") >= ARTICLE_PAGES) & share("n", ARTICLE_SHARE)).otherwise((F.col("kind") == slot_inside) & share("n", ARTICLE_SHARE))
    return often.groupBy("of_host").agg(F.collect_list(F.when(around, F.col("hash"))).alias("of_site"), F.collect_list(F.when(everywhere, F.col("hash"))).alias("of_article"))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", aid: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    ``text`` has the page's blocks in order, joined by one space, inside and
    outside of articles: nothing goes but because it recurs on its host, or by
    its name, class or role as the module says; without ``aid`` these decide
    nothing on hosts with ``LEAST_PAGES`` different pages. It is empty
    for null and empty pages and for pages without text. A page whose address
    is null or has no host belongs to no site, so nothing of it is a template.
    Markup may be broken in any way and pages of any length.
    Null ids and repeated rows pass through row by row, other columns are not
    read, and an empty table gives an empty result.
    """
    col = lambda name: F.col(f"`{name}`")
    source = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    host = host_of(F.col("url"))
    source = source.withColumn("host", F.when(host != "", F.xxhash64(host)))
    # As a stored table the templates have a known size: Spark broadcasts them only if they are small, and else
    # shuffles pages by host, where it can split the partitions of large hosts.
    known = Scratch(pages.sparkSession, "templates").write(templates(source.where("host is not null")), "hosts")
    joined = source.join(known, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "host", "of_site", "of_article")
    kind = source.schema["page_id"].dataType.simpleString()

    def extract(batches):
        sites: dict[int | None, Site] = {}
        mask = (1 << 64) - 1
        for b in rows(batches, 256):
            texts = []
            for k, (page, host_) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if host_ not in sites:
                    if len(sites) > 1000:
                        sites = {}
                    around, everywhere = (b.column(c)[k].as_py() for c in (4, 5))
                    sites[host_] = Site() if around is None else Site(frozenset(x & mask for x in around), frozenset(x & mask for x in everywhere), True, aid)
                if page:
                    digest(root := parse(page))
                    texts.append(text_of(root, sites[host_]))
                else:
                    texts.append("")
            yield batch(pa.schema([("page_id", b.schema.field(0).type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]), b.column(0), b.column(1), texts, list(map(len, texts)))

    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint")


__all__ = ["Site", "clean", "digest", "extracted", "host_of", "parse", "slot", "subtrees", "templates", "text_of"]
