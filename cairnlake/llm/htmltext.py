"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out by element or by the words of their class and id, as are hidden
elements and what stands in for media that a browser shows instead. A class that names the article outweighs
others beside it that would drop it. Each block of text gives points (one, one a comma, and up to three for its length)
to the container that it stands in, fewer to the five around that, each discounted by link density; elements that state
that they hold the article get them in full, up to four of them within 64 levels. The container with most points is kept,
with those of its siblings that score alike or read like paragraphs. Captions are part of the article.

Open elements are found by name and kind, not by walking the stack, so a page takes time in proportion to its length.

Character references are decoded, white space inside a block becomes one space, and blocks are joined in
page order by one space. Defined results: null, empty or text-less pages give an empty text; markup that is cut
off at the end is dropped; text without markup is kept whole; repeated rows are extracted each; an empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript svg math template".split())
DROPPED = frozenset("nav header footer aside form button select option label input dialog menu object canvas audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body center details div html main section td".split())
#: An open element of the first kind is closed by the start of one of the second.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Elements inside which the start of an item does not close one outside.
ITEM_SCOPE = frozenset("ul ol dl table select article body div section".split())
P_SCOPE = frozenset("table td th caption html button object template".split())
#: Words of class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars navigation nav navbar menu menus submenu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing shares social related recommended recommendations trending comment comments commentlist disqus replies reply respond pagination pager toolbar widget widgets search skip outbrain taboola contentinfo complementary".split()
)
#: Words of class, id or itemprop that mark the article.
ARTICLE = frozenset("articlebody article post entry content story main".split())
#: Of these, words that name the article itself when their class has no word of the other list.
STRONG = frozenset("articlebody article post entry story".split())

_END = re.compile(r'[^>"\']*+(?:"[^"]*+"[^>"\']*+|\'[^\']*+\'[^>"\']*+)*+>')
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "block", "box", "dropped", "article", "begin", "end", "points", "chars", "links", "kids")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool, article: bool, begin: int) -> None:
        self.tag, self.parent, self.dropped, self.article, self.begin = tag, parent, dropped, article, begin
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        self.box: Node = self if parent is None or tag in CONTAINERS else parent.box
        self.end = -1
        self.points = 0.0
        self.chars = self.links = 0
        self.kids: list[Node] = []


def marks(attrs: str) -> tuple[bool, bool, bool]:
    """(is marked as not the article, is marked as the article, is hidden)"""
    no = yes = strong = hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            for word in value.split():
                parts = {w.lower() for w in _PARTS.findall(word)} | {word.lower()}
                bad, good = not parts.isdisjoint(NOT_ARTICLE), not parts.isdisjoint(ARTICLE)
                no, yes = no or bad, yes or good
                strong = strong or not bad and not parts.isdisjoint(STRONG)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            hidden = True
    return no and not strong, yes, hidden


#: Kinds of open elements whose places on the stack are kept.
KINDS = (BLOCKS, CONTAINERS, P_SCOPE | CONTAINERS, frozenset(CLOSED_BY), ITEM_SCOPE)


class Page:
    """The tree and, in page order, its pieces of text (str) and block breaks (None)."""

    def __init__(self, source: str) -> None:
        self.root = Node("html", None, False, False, 0)
        self.stack = [self.root]
        self.nodes = [self.root]
        # places on the stack of the open elements, by name and by kind
        self.named: dict[str, list[int]] = {}
        self.kinds: tuple[list[int], ...] = tuple([0] for _ in KINDS)
        self.pieces: list = []
        self.spans: list[tuple[int, int, Node, int]] = []  # blocks: first piece, last piece, element, link characters
        self.block_from, self.block_links, self.in_link = 0, 0, 0
        self.read(source)
        self.flush()
        for node in self.stack:
            node.end = len(self.pieces)

    def flush(self) -> None:
        if len(self.pieces) > self.block_from:
            self.spans.append((self.block_from, len(self.pieces), self.stack[-1].block, self.block_links))
        self.pieces.append(None)
        self.block_from, self.block_links = len(self.pieces), 0

    def text(self, raw: str) -> None:
        if not self.stack[-1].dropped and raw:
            got = _html.unescape(raw) if "&" in raw else raw
            self.pieces.append(got)
            if self.in_link:
                self.block_links += len(got.strip())

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.named.setdefault(node.tag, []).append(at)
        for kind, places in zip(KINDS, self.kinds):
            if node.tag in kind:
                places.append(at)
        self.stack.append(node)

    def pop(self, depth: int) -> None:
        """Closes the elements from a place on."""
        if self.kinds[0][-1] >= depth:
            self.flush()
        while len(self.stack) > depth:
            node = self.stack.pop()
            node.end = len(self.pieces)
            self.in_link -= node.tag == "a"
            self.named[node.tag].pop()
            for places in self.kinds:
                if places[-1] == len(self.stack):
                    places.pop()

    def last(self, tag: str) -> int:
        """Place of the last open element of a name; 0 for none."""
        places = self.named.get(tag)
        return places[-1] if places else 0

    def close_before(self, tag: str) -> None:
        """Closes what the start of ``tag`` closes without an end tag."""
        _, _, p_scope, items, item_scope = self.kinds
        if tag in BLOCKS and self.last("p") > p_scope[-1]:
            self.pop(self.last("p"))
        while items[-1] and items[-1] >= item_scope[-1]:
            item = self.stack[items[-1]].tag
            if tag not in CLOSED_BY[item]:
                break
            self.pop(items[-1])
            if item not in ("td", "th") or tag in ("td", "th"):
                break

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br" or tag == "hr":
            if tag == "hr":
                self.close_before(tag)
                self.flush()
            elif not self.stack[-1].dropped:
                self.pieces.append(" ")
            return
        if tag in VOID or tag == "head":
            return
        self.close_before(tag)
        if tag in BLOCKS:
            self.flush()
        parent = self.stack[-1]
        no, yes, hidden = marks(attrs) if attrs else (False, False, False)
        dropped = parent.dropped or tag in DROPPED or hidden or (no and tag not in ("article", "main"))
        node = Node(tag, parent, dropped, tag in ("article", "main") or (yes and tag in CONTAINERS), len(self.pieces))
        parent.kids.append(node)
        self.nodes.append(node)
        self.push(node)
        self.in_link += tag == "a"
        if attrs.endswith("/") and tag not in BLOCKS:
            self.pop(len(self.stack) - 1)

    def finish(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            return self.start("br", "")
        at = self.last(tag)
        blocked = self.kinds[0][-1] if tag not in BLOCKS else self.kinds[1][-1] if tag == "p" else 0
        if at and at >= blocked:
            self.pop(at)

    def read(self, s: str) -> None:
        at, n = 0, len(s)
        low = None
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                return self.text(s[at:])
            if lt > at:
                self.text(s[at:lt])
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            name = _NAME.match(s, lt + 1)
            if not name:
                if s[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            whole = _END.match(s, name.end())
            end = whole.end() if whole else s.find(">", name.end()) + 1
            if not end:
                return None
            tag = name.group().lower()
            at = end
            if tag[0] == "/":
                self.finish(tag[1:])
            elif tag in RAW:
                if s[end - 2] == "/" and tag in ("svg", "math"):
                    continue
                if low is None:
                    low = s.lower() if len(s.lower()) == n else "".join(c.lower() if c.isascii() else c for c in s)
                close = low.find("</" + tag, end)
                stop = low.find(">", close) if close >= 0 else -1
                at = n if stop < 0 else stop + 1
            else:
                self.start(tag, s[name.end() : end - 1])
        return None

    def words(self, a: int, b: int) -> str:
        return " ".join("".join(" " if x is None else x for x in self.pieces[a:b]).split())

    def main(self) -> str:
        for a, b, node, links in self.spans:
            text = " ".join("".join(self.pieces[a:b]).split())
            if not text:
                continue
            links = min(links, len(text))
            points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - links / len(text))
            at = node.box
            at.chars += len(text)
            at.links += links
            share, stated, level = 1.0, 0, 0
            while at is not None and (level < 6 or stated < 4 and level < 64):
                if at.article:
                    at.points += points * (1 if at.tag == "article" else 0.9)
                    stated += 1
                elif level < 6:
                    at.points += points * share
                level += 1
                if at.tag in CONTAINERS:
                    share = 1 / (2 * level) if level < 3 else 1 / (3 * level)
                at = at.parent
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.links += node.links
        score = lambda x: x.points * (1 - x.links / x.chars) if x.chars else 0.0
        best = max((x for x in self.nodes if x.tag in CONTAINERS and not x.dropped), key=score)
        if not score(best):
            return self.words(0, len(self.pieces)) if not best.chars else self.words(best.begin, best.end)
        if best.parent is None:
            return self.words(0, len(self.pieces))
        kept = []
        for kid in best.parent.kids:
            if kid is best:
                kept.append(kid)
            elif not kid.dropped and kid.chars and kid.tag in CONTAINERS:
                if score(kid) >= max(10, 0.2 * score(best)) and kid.links < 0.25 * kid.chars and (kid.tag == best.tag or not best.article):
                    kept.append(kid)
            elif not kid.dropped and not best.article and kid.tag in BLOCKS:
                text = self.words(kid.begin, kid.end)
                if len(text) > 80 or kid.tag in ("h1", "h2", "h3") and text:
                    kept.append(kid)
        return " ".join(t for t in (self.words(k.begin, k.end) for k in kept) if t)


def main_text(source: str | None) -> str:
    return Page(source).main() if source else ""


def extract(batches):
    for part in (part for batch in batches for part in slices(batch, "html")):
        texts = [main_text(h) for h in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Contract: every page, its whole html."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
