"""Main text of web pages by composite text density.

A page is read into a tree of its elements in one pass. Elements that are no article by what they
declare (navigation, forms, asides, adverts, notices, comments: tag, role, or words of class and id)
leave the tree. Every remaining node gets its characters and tags with those inside links, and from them
its density: characters a tag, adjusted by the logarithm to a base that grows with the share of link
text. A block's sum is that of the densities of the blocks it holds (a block that holds none has its
own). The block of the largest sum is the core. The least density on the path from the core to
the body is the threshold: as long as a block beside the path reaches it, the core widens to their
common parent, and it widens to the article or main element that it lies in. All text of the core is
the result, but for lists that consist of links alone.

Character references are decoded; white space inside a block (also a line break) becomes one space;
blocks are joined in page order by two line feeds. Null and empty pages, and pages without text,
give an empty text. Markup may be broken anywhere: nothing recurses, and reading is linear in a
page's length, so pages of any length and depth are read whole. Ties go to the first block of the page.
Rows are kept one by one, repeated or not, whatever other columns the table has. An empty
table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of the markup language by what they do to text.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu "
    "nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes xmp object applet embed svg canvas audio video map textarea select datalist button fieldset input nav aside footer menu dialog search".split())
LANDMARKS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("table tr td th thead tbody tfoot caption".split())
LISTS = frozenset("ul ol dl table div section".split())
#: What a start tag ends, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words of class and id, and roles, of what surrounds an article.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox adslot adunit banner banners sponsor sponsored promo promotion nav navbar navigation topnav subnav sidenav leftnav mainnav menu menus breadcrumb breadcrumbs "
    "sidebar sidebars rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications disclaimer alert popup modal overlay newsletter subscribe "
    "subscription signup login form comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social widget widgets pagination pager "
    "copyright search skip hidden teaser teasers outbrain taboola".split()
)
PAGE_ONLY_WORDS = frozenset(["header"])  # an article has a header of its own
#: Words by which an article element is none.
ARTICLE_CHROME_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser teasers".split())
QUALIFIERS = frozenset("has with no without is".split())
CHROME_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar note tooltip".split())

_TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|/([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>?"
    r"|[!?/][^>]*>?)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def declared(tag: str, attributes: str, in_article: bool) -> int:
    """What an element declares itself to be: 0 text, 1 surely none of an article's, 2 probably none."""
    if tag in HIDDEN or (tag == "header" and not in_article):
        return 1
    if tag in ("html", "body"):
        return 0
    if not attributes or attributes.isspace():
        return 2 * (tag == "form")
    words = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _INVISIBLE.search(value)):
            return 1
        if name == "role" and value.strip().lower() in CHROME_ROLES:
            return 1
        if name in ("class", "id"):
            for one in value.split():
                qualified = False
                for word in map(str.lower, _WORDS.findall(one)):
                    words += [] if qualified else [word]
                    qualified = word in QUALIFIERS
    if tag in LANDMARKS:
        return 2 * (tag == "article" and any(w in ARTICLE_CHROME_WORDS for w in words))
    return 2 * (tag == "form" or any(w in CHROME_WORDS or (w in PAGE_ONLY_WORDS and not in_article) for w in words))


class Page:
    """The tree of a page, by node: parent, tag, the block it lies in, what it declares; and its texts in order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.block, self.declares = [-1], ["#page"], [-1], [0]
        self.linked, self.in_article = [False], [False]
        self.texts: list[tuple[int, str | None]] = []  # (node, text); None for the text is an edge of a block
        self._stack, self._open, self._blocks, self._cells = [0], {}, [0], [0]
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            cut = source.find("<", at)
            if cut < 0:
                cut = end
            if cut > at:
                self._text(source[at:cut])
            if cut == end:
                return
            m = _TOKEN.match(source, cut)
            if not m:
                self._text("<")
                at = cut + 1
                continue
            at = m.end()
            if m[1]:
                self._close(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                self._start(tag, m[3])
                if tag in RAW:
                    found = _RAW_END[tag].search(source, at)
                    at = found.start() if found else end

    def _text(self, text: str) -> None:
        if self.tag[self._stack[-1]] == "head" and not text.isspace():
            self._pop(len(self._stack) - 1)
        self.texts.append((self._stack[-1], html.unescape(text) if "&" in text else text))

    def _nearest(self, tags: frozenset[str]) -> int:
        """Place in the stack of the innermost of these elements, or 0."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body", "head") and self._open.get(tag):
            return
        if self.tag[self._stack[-1]] == "head" and tag not in IN_HEAD:
            self._pop(len(self._stack) - 1)
        block = tag in BLOCKS
        if block and self._open.get("p") and self._open["p"][-1] > self._cells[-1]:
            self._pop(self._open["p"][-1])
        if tag in ENDS:
            same, bound = ENDS[tag]
            nearest = self._nearest(same)
            if nearest > max(self._nearest(bound), 0 if tag in TABLE_PARTS else self._cells[-1]):
                self._pop(nearest)
        if tag in HEADINGS and (nearest := self._nearest(HEADINGS)) and nearest == self._blocks[-1]:
            self._pop(nearest)
        up = self._stack[-1]
        node = len(self.tag)
        self.parent.append(up)
        self.tag.append(tag)
        self.block.append(up if up == 0 or self.tag[up] in BLOCKS else self.block[up])
        self.declares.append(declared(tag, attributes, self.in_article[up]))
        self.linked.append(self.linked[up] or tag == "a")
        self.in_article.append(self.in_article[up] or tag in LANDMARKS)
        if block:
            self.texts.append((up, None))
        elif tag == "br":
            self.texts.append((up, " "))
        if tag in VOID:
            return
        place = len(self._stack)
        self._stack.append(node)
        self._open.setdefault(tag, []).append(place)
        if block:
            self._blocks.append(place)
        if tag in CELLS:
            self._cells.append(place)

    def _pop(self, place: int) -> None:
        """Close what is open from that place of the stack on."""
        while len(self._stack) > place:
            node = self._stack.pop()
            self._open[self.tag[node]].pop()
            if self.tag[node] in BLOCKS:
                self.texts.append((self.parent[node], None))
            for open_ in (self._blocks, self._cells):
                if open_[-1] == len(self._stack):
                    open_.pop()

    def _close(self, tag: str) -> None:
        places = self._open.get(tag)
        if not places or tag in ("html", "body"):
            return
        # an end tag doesn't reach out of a table's cell, nor that of an inline element out of a block
        if tag in TABLE_PARTS or (places[-1] > self._cells[-1] and (tag in BLOCKS or places[-1] > self._blocks[-1])):
            self._pop(places[-1])

    def chrome(self) -> list[bool]:
        """Of each node whether it lies in what is none of an article's text. What is so only probably
        doesn't count where it holds the page's main element or its only article."""
        n = len(self.tag)
        articles = [k for k in range(n) if self.tag[k] == "article" and not self.declares[k]]
        holds = [False] * n
        for k in [k for k in range(n) if self.tag[k] == "main"] + (articles if len(articles) == 1 else []):
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = self.parent[k]
        out = [False] * n
        for k in range(1, n):
            out[k] = out[self.parent[k]] or self.declares[k] == 1 or (self.declares[k] == 2 and not holds[k])
        return out


def _visible(text: str) -> int:
    return len(text) - sum(map(text.count, " \n\t\r"))


class Densities:
    """Of each node that isn't chrome: characters, those inside links, links, density, and sum of its blocks' densities."""

    def __init__(self, page: Page, chrome: list[bool]):
        n = len(page.tag)
        self.chars, self.link_chars, self.links = [0] * n, [0] * n, [0] * n
        tags, link_tags = [0] * n, [0] * n
        for node, text in page.texts:
            if text is not None and not chrome[node]:
                size = _visible(text)
                self.chars[node] += size
                self.link_chars[node] += size * page.linked[node]
        for k in range(n - 1, 0, -1):
            if not chrome[k]:
                up = page.parent[k]
                self.chars[up] += self.chars[k]
                self.link_chars[up] += self.link_chars[k]
                self.links[up] += self.links[k] + (page.tag[k] == "a")
                tags[up] += tags[k] + 1
                link_tags[up] += link_tags[k] + page.linked[k]
        share = self.link_chars[0] / max(self.chars[0], 1)
        self.density, self.sums, blocks = [0.0] * n, [0.0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            if chrome[k] or not self.chars[k]:
                continue
            c, lc, t, lt = self.chars[k], self.link_chars[k], max(tags[k], 1), max(link_tags[k], 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            # text without any link has base 1 at least; the more of it is link text, the larger the base
            self.density[k] = c / t * math.log1p(c / max(lc, 1) * t / lt) / max(base, 1.0)
            if not blocks[k]:
                self.sums[k] = self.density[k]
            if k and page.tag[k] in BLOCKS:
                up = page.block[k]
                if not blocks[up]:
                    self.sums[up] = 0.0
                blocks[up] += 1
                self.sums[up] += self.density[k]


def core(page: Page, chrome: list[bool], of: Densities) -> int:
    """The block that holds the article, or -1 where there is no text."""
    n = len(page.tag)
    text_blocks = [k for k in range(n) if not chrome[k] and of.chars[k] and (k == 0 or page.tag[k] in BLOCKS)]
    if not text_blocks:
        return -1
    # a page that declares one article, or one main element, has its text there
    for tag in ("article", "main"):
        one = [k for k in text_blocks if page.tag[k] == tag]
        if len(one) == 1:
            return one[0] if len(text_blocks) == 1 else _widened(page, text_blocks, of, one[0])
    return _widened(page, text_blocks, of, 0)


def _widened(page: Page, text_blocks: list[int], of: Densities, top: int) -> int:
    """The block of the largest sum below top, widened by the threshold of its path."""
    below = [False] * len(page.tag)
    for k in text_blocks:
        below[k] = k == top or (k > 0 and below[page.block[k]])
    best = max((k for k in text_blocks if below[k]), key=lambda k: (of.sums[k], -k))
    path, k = [best], best
    while k != top:
        k = page.block[k]
        path.append(k)
    threshold = min(of.density[k] for k in path)
    on_path, out = set(path), best
    beside = {page.block[k] for k in text_blocks if k and k not in on_path and below[k] and of.density[k] >= threshold}
    for k in path:
        if k in beside:
            out = k
    # the article or main element around it, where there is one
    k = out
    while k >= 0:
        if page.tag[k] in LANDMARKS:
            return k
        k = page.block[k]
    return out


def main_text(source: str | None) -> str:
    """Text of the page's article; see the module."""
    page = Page(source or "")
    chrome = page.chrome()
    of = Densities(page, chrome)
    top = core(page, chrome, of)
    kept = [False] * len(page.tag)
    for k in range(len(page.tag)):
        menu = k != top and page.tag[k] in LISTS and of.links[k] > 1 and of.link_chars[k] == of.chars[k]
        kept[k] = not chrome[k] and not menu and (k == top or (k > 0 and kept[page.parent[k]]))
    blocks, own = [], []
    for node, text in [*page.texts, (0, None)]:
        if text is None:
            if block := " ".join("".join(own).split()):
                blocks.append(block)
            own = []
        elif kept[node]:
            own.append(text)
    return "\n\n".join(blocks)


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns per row (id_col, url_col, text, n_chars); see the module."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    schema = T.StructType([rows.schema["id"], rows.schema["url"]]).add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
