"""Operator 3, HTML extraction with a site style tree.

The DOMs of a host's pages are merged: nodes at the same path with the same presentation (tag,
class, id, role) are one node of the site's style tree.  Over the pages that have it, the node's
presentations below it and its contents have an entropy, to the base of the number of pages;
what looks and reads the same everywhere has none.  Both give the node's importance

    prior * ((1 - g^l) * presentation + g^l * content),      l: its usual number of child tags,

and branches of low importance are taken off every page of the host.  Names are a prior: what HTML
itself calls no main text (nav, header, footer, aside, form, script, ..) has 0, and so have
containers that their class or id names as such (`ad`, `share-box`); on paragraphs and other
elements of running text such words, but for adverts and comments, only halve the importance, and a
name with another word in it (`share-price`) says nothing.

Every branch is judged, inside what the page marks as its article too.  There the same structure
around other words is no template, so the entropy of the contents alone decides, and only for
branches with text on at least `article_share` of the host's pages: passages that a few articles
share stay.  Branches of one page with the same path are one node, with all their text.  What lies
outside a marked article is not the article.

Tags are read by the rules of HTML: a quote inside an unquoted value is part of it, after a quoted
value the next attribute begins, a tag cut off by the end of the page goes.  An attribute that is
never closed ends at the next `>`.  Parsing and hashing are linear in the page, however deep it is.

Importances come from counts that are combined map-side, so one host with a third of all pages
costs no single task.  Low branches are few (they recur on `min_pages` pages); they are broadcast
if counted below `broadcast_nodes`, else joined by host, which adaptive execution may split.

Defined results: null or empty html gives an empty text; a page without article keeps what no
rule removes; were the style tree to leave nothing of a page or of its article (all its pages
alike), it is not used there; a null url is the host ''; repeated rows each come out; no rows, no result; other
columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, table
from tidemark.llm.urls import parts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that are never main text.
NEVER = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe svg canvas object audio video dialog menu title map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class or id that name what is not main text, on any element ..
SURE = frozenset(
    """ad ads advert adverts advertisement advertisements sponsor sponsored cookie cookies consent comment comments disqus newsletter
    breadcrumb breadcrumbs sidebar navbar nav""".split()
)
#: .. and on containers; elements of running text lose half their importance.
NOISE = SURE | frozenset(
    """banner promo promotion notice notification alert popup modal overlay subscribe subscription signup login menu navigation footer
    header masthead toolbar widget reply replies respond related recommended share sharing social pagination pager copyright
    legal""".split()
)
#: Words that may stand beside these in a name without changing what it says.
PLAIN = frozenset(
    """area article articles bar block blog bottom box btn button buttons container content group icon icons inner item items label left
    links list main outer page panel post posts primary reader right row secondary section site slot text title top unit user users
    wrap wrapper zone""".split()
)
#: Elements of running text.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot table caption blockquote pre figure figcaption".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption""".split()
)
#: Items that a start tag closes first, and what holds items apart.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("table ul ol dl select menu".split())
SCOPE = frozenset("table td th ul ol dl article section div body main".split())
_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
#: Attributes up to the end of the tag.
_REST = re.compile(r"""((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>""")
_ATTR = re.compile(r"""(=?+[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[^a-z]+")


@lru_cache(maxsize=20_000)
def prior(tag: str, names: str, role: str) -> float:
    """What tag, class with id, and role say of a node before any page of its host is seen."""
    if tag in NEVER or role in ROLES:
        return 0.0
    running = tag in RUNNING or tag not in BLOCKS and tag != "body"
    least = 1.0
    for name in names.split():
        words = {w for w in _WORD.split(name) if w}
        if words.isdisjoint(NOISE) or not words <= NOISE | PLAIN:
            continue
        least = min(least, 0.5 if running and words.isdisjoint(SURE) else 0.0)
    return least


class Node:
    """An element.  p, item: the open paragraph or list item that it stands in, if no scope lies
    between."""

    __slots__ = ("tag", "look", "prior", "parent", "items", "path", "p", "item")

    def __init__(self, tag: str, attrs: str, parent: "Node | None") -> None:
        self.tag, self.parent, self.items = tag, parent, []
        found: dict[str, str] = {}
        if "=" in attrs:
            for m in _ATTR.finditer(attrs):
                name = m[1].lower()
                if name in ("class", "id", "role"):
                    found.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
        self.look = f"{tag}.{found.get('class', '')}#{found.get('id', '')}@{found.get('role', '')}"
        self.prior = prior(tag, f"{found.get('class', '')} {found.get('id', '')}".lower(), found.get("role", "").strip().lower()) if found else float(tag not in NEVER)
        self.path = xxhash.xxh64_intdigest(self.look, parent.path if parent else 0)
        self.p = self.item = None
        if parent is not None:
            self.p = parent if parent.tag == "p" else None if parent.tag in SCOPE else parent.p
            self.item = parent if parent.tag in CLOSES else None if parent.tag in LISTS else parent.item

    @property
    def noise(self) -> bool:
        return self.prior == 0


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def parse(html: str) -> Node:
    """The DOM, with implied end tags; items are nodes and decoded strings."""
    root = at = Node("#root", "", None)
    opened: Counter = Counter()
    text, pos, n = 0, 0, len(html)  # text: where the text not yet taken begins

    def close(upto: Node) -> Node:
        """Ends the open elements from the innermost to `upto`; each ends once."""
        now = at
        while now is not upto:
            opened[now.tag] -= 1
            now = now.parent
        opened[upto.tag] -= 1
        return upto.parent

    while (m := _MARK.search(html, pos)) is not None:
        if m.start() > text:
            at.items.append(unescape(html[text : m.start()]))
        text = n  # a tag or comment cut off by the end goes
        if not m[2]:
            if html.startswith("<!--", m.start()):
                end = _COMMENT_END.search(html, m.start() + 2)
                pos = end.end() if end else n
            else:
                pos = html.find(">", m.end()) + 1 or n
            text = pos
            continue
        rest = _REST.match(html, m.end())
        if rest is None:
            break
        pos = text = rest.end()
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                up = at
                if tag == "p":
                    up = at if at.tag == "p" else at.p
                else:
                    while up.tag != tag:
                        up = up.parent
                if up is not None:
                    at = close(up)
            continue
        if tag in BLOCKS:  # a block ends an open paragraph
            up = at if at.tag == "p" else None if at.tag in SCOPE else at.p
            if up is not None:
                at = close(up)
        if tag in CLOSES:
            up, last = at if at.tag in CLOSES else None if at.tag in LISTS else at.item, None
            while up is not None and up.tag in CLOSES[tag]:
                up, last = up.item, up
            if last is not None:
                at = close(last)
        node = Node(tag, rest[1], at)
        at.items.append(node)
        if tag in VOID or rest[1].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            stop = _end_of(tag).search(html, pos)
            end = stop.start() if stop else n
            node.items.append(unescape(html[pos:end]) if tag in ("title", "textarea") else html[pos:end])
            pos = text = (html.find(">", stop.end()) + 1 or n) if stop else n
            continue
        opened[tag] += 1
        at = node
    if text < n:
        at.items.append(unescape(html[text:]))
    return root


def blocks(node: Node, low: frozenset[int] | set[int] = frozenset(), free: bool = False, spans: list | None = None) -> list[str]:
    """Text blocks under `node` in page order.  low: paths of unimportant branches, obeyed unless
    `free`.  spans: takes [element, first block, end] of every block element kept."""
    out: list[str] = []
    text: list[str] = []

    def close() -> None:
        words = "".join(text).split()
        if words:
            out.append(" ".join(words))
        text.clear()

    # (node, index) stack: no recursion, so any depth will do
    stack: list[tuple[Node, Iterator, list | None]] = [(node, iter(node.items), None)]
    while stack:
        top, items, span = stack[-1]
        for x in items:
            if isinstance(x, str):
                text.append(x)
            elif x.noise or not free and x.path in low:
                if x.tag in BLOCKS:
                    close()
            elif x.tag in VOID:
                if x.tag in ("br", "hr", "wbr"):
                    close() if x.tag == "hr" else text.append(" " if x.tag == "br" else "")
            else:
                if x.tag in BLOCKS:
                    close()
                elif x.tag in ("td", "th"):
                    text.append(" ")
                span = None
                if spans is not None and x.tag in BLOCKS:
                    span = [x, len(out), 0]
                    spans.append(span)
                stack.append((x, iter(x.items), span))
                break
        else:
            stack.pop()
            if top.tag in BLOCKS:
                close()
            if span is not None:
                span[2] = len(out)
    close()
    return out


def _elements(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.items) if not isinstance(c, str)]


def mains(root: Node) -> list[Node]:
    """The outermost elements that the page marks as its article."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.noise:
            continue
        if x.tag == "article":
            out.append(x)
        else:
            stack += [c for c in reversed(x.items) if not isinstance(c, str)]
    if not out:
        out = [x for x in _elements(root) if x.tag == "main" and not x.noise][:1]
    return out


def main_text(html: str | None, low: frozenset[int] | set[int] = frozenset()) -> str:
    root = parse(html or "")
    found = mains(root)
    marked = [b for x in found for b in blocks(x, low)] or [b for x in found for b in blocks(x, free=True)]
    if marked:
        return "\n".join(marked)
    return "\n".join(blocks(root, low) or blocks(root, free=True))


#: The node of whole pages: it counts the pages of a host.
ROOT = Node("#root", "", None).path


_P, _BASE = (1 << 61) - 1, 0x1D8AF066F7A3B0C5


class Ranges:
    """A hash of any range of a page's blocks at once, by a polynomial modulo a prime."""

    def __init__(self, text: list[str]) -> None:
        self.sums, self.powers = [0], [1]
        for t in text:
            self.sums.append((self.sums[-1] * _BASE + xxhash.xxh64_intdigest(t) + 1) % _P)
            self.powers.append(self.powers[-1] * _BASE % _P)

    def of(self, start: int, end: int) -> bytes:
        return ((self.sums[end] - self.sums[start] * self.powers[end - start]) % _P).to_bytes(8, "little")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every branch of every page: host, style node, its prior, its child tags' number, whether it
    is in the article, and a hash of its presentation (kind 0) and of its content (kind 1).
    Branches of the article count where they have text."""
    for b in batches:
        rows: list[tuple[str, int, float, int, bool, int, int]] = []
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            host, root = parts(url)[0], parse(html or "")
            inside = {id(y) for x in mains(root) for y in _elements(x) if y is not x}
            spans: list = []
            text = blocks(root, free=True, spans=spans)
            ranges, nodes = Ranges(text), {}
            for x, start, end in [(root, 0, len(text)), *spans]:
                if start == end and id(x) in inside:
                    continue
                if x.path not in nodes:
                    nodes[x.path] = [x, 0, 0, xxhash.xxh64(), xxhash.xxh64()]
                of = nodes[x.path]
                looks = [c.look for c in x.items if not isinstance(c, str)]
                of[1] += 1
                of[2] += len(looks)
                of[3].update("\n".join(looks) + "\0")
                of[4].update(ranges.of(start, end))
            for path, (x, n, children, look, content) in nodes.items():
                for kind, what in ((0, look), (1, content)):
                    rows.append((host, _signed(path), x.prior, children // n, id(x) in inside, kind, _signed(what.intdigest())))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "node", "prior", "children", "inside", "kind", "feature"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_tree(pages: DataFrame, *, decay: float = 0.9) -> DataFrame:
    """(host, node, prior, inside, pages, presentation, content, importance) of the merged style
    nodes; inside: within the article of some page."""
    schema = "host string, node long, prior double, children int, inside boolean, kind int, feature long"
    seen = pages.select("url", "html").mapInArrow(_features, schema)
    counted = seen.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("c"), F.sum("children").alias("l"), F.max("inside").alias("inside"), F.min("prior").alias("prior"))
    n, term = F.sum(F.when(F.col("kind") == 0, F.col("c"))), F.col("c") * F.log("c")
    sums = counted.groupBy("host", "node").agg(
        F.max("inside").alias("inside"),
        F.min("prior").alias("prior"),
        n.alias("pages"),
        F.sum(F.when(F.col("kind") == 0, term)).alias("s0"),
        F.sum(F.when(F.col("kind") == 1, term)).alias("s1"),
        (F.sum(F.when(F.col("kind") == 0, F.col("l"))) / n).alias("l"),
    )

    def entropy(s: str):  # -sum p log_m p = 1 - sum c ln c / (m ln m)
        return F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(1 - F.col(s) / (F.col("pages") * F.log("pages")))

    weight = F.pow(F.lit(decay), F.col("l"))
    merged = sums.select("host", "node", "prior", "inside", "pages", entropy("s0").alias("presentation"), entropy("s1").alias("content"), weight.alias("w"))
    both = (1 - F.col("w")) * F.col("presentation") + F.col("w") * F.col("content")
    return merged.select("host", "node", "prior", "inside", "pages", "presentation", "content", (F.col("prior") * both).alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            texts.append(main_text(html, {x & (1 << 64) - 1 for x in low} if low else frozenset()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, *, threshold: float = 0.3, min_pages: int = 5, article_share: float = 0.5, broadcast_nodes: int = 100_000) -> DataFrame:
    """(page_id, url, text) for every page."""
    whole, unlike = F.col("node") == _signed(ROOT), F.when(F.col("inside"), F.col("prior") * F.col("content")).otherwise(F.col("importance"))
    tree = style_tree(pages).where((F.col("pages") >= min_pages) & (whole | (unlike < threshold))).select("host", "node", "inside", "pages").checkpoint()
    hosts = tree.where(whole).select("host", F.col("pages").alias("all"))
    common = tree.where(~whole & F.col("inside")).join(hosts, "host").where(F.col("pages") >= article_share * F.col("all"))
    low = tree.where(~whole & ~F.col("inside")).select("host", "node").unionByName(common.select("host", "node"))
    n = low.count()
    by_host = low.groupBy("host").agg(F.collect_list("node").alias("low"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of("url").alias("host"))
    if n:
        joined = rows.join(F.broadcast(by_host) if n <= broadcast_nodes else by_host, "host", "left")
    else:
        joined = rows.withColumn("low", F.lit(None).cast("array<long>"))
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string")


def host_of(url: str):
    """The host as in `urls.parts`, with column functions."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
