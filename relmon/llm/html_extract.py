"""Main-text extraction with removal of site templates.

Each page is parsed into a tree of elements.  Element subtrees are hashed
(tags, attributes that are not links, text), and Spark counts on how many
pages of a host each hash occurs.  Subtrees that recur on many pages of their
host are templates - menus, notices, footers - and are deleted.  What is left
of the article is the main text.

Blocks whose text differs from page to page (reader comments, sidebars, related
articles) recur in structure: a second hash, of an element's tag and names alone, is
counted where a word of the names hints at no article text ("comment-list",
"site-sidebar"); if it recurs on the host, the block is deleted whatever its text and size.

Elements whose name, role, class or id as a whole says that they are no article text
(navigation, adverts, forms, comments ...) go as well, so a host with few
pages is treated like any other.  Those names are whole tokens, and never those of the
page, its article or what holds most of its text.  Inside the article - or the
densest text block, where a page marks none - paragraphs, headings, lists and the
like, and blocks that merely wrap them, are not candidates for deletion: passages that several articles share, and
copies of a whole article, are article text however often they recur.  Pages of
a host with the same main content count once.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import stage

MIN_PAGES = 3            # a template recurs on at least so many pages of its host
MIN_SHARE = 0.1          # and on this share of them,
MANY_PAGES = 30          # or on so many

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
# Elements and names that are no article text.
NOT_TEXT = frozenset("head nav footer aside form button select input menu dialog object svg canvas audio video".split()) | RAW
NOT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav "
                      "navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup "
                      "modal newsletter subscribe signup share sharing social related recommended comment comments "
                      "respond reply replies disqus skip pagination pager".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table figure figcaption".split())
PARAGRAPH = frozenset("p pre blockquote".split())
CANDIDATES = frozenset("div section nav aside footer header ul ol dl table form p menu".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {t: re.compile(rf"</{t}[^>]*(?:>|\Z)", re.I) for t in RAW}
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "names", "named", "hint", "inner", "hash", "shape", "root", "has_root", "size", "own", "para")

    def __init__(self, tag: str, names: tuple = (), named: bool = False, hint: bool = False):
        self.tag, self.names, self.named, self.hint, self.inner = tag, names, named, hint, []
        # of the whole subtree; of its tag and names only (where a name hints at no article text)
        self.hash, self.shape, self.root, self.has_root = 0, 0, False, False
        # characters of text; of its own and its inline elements' text; whether paragraphs are inside
        self.size, self.own, self.para = 0, 0, False


def _names(attrs: str) -> tuple[tuple[str, ...], bool, bool]:
    """Words of class, id and role, whether a whole token of them consists of names that
    are no article text, and whether any word is one."""
    if "=" not in attrs:
        return (), False, False
    out, named = [], False
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                words = _NAME.findall(token)
                out += words
                named = named or bool(words) and NOT_NAMES.issuperset(words)
    return tuple(out), named, not NOT_NAMES.isdisjoint(out)


def parse(page: str) -> Node:
    """The page as a tree.  Unclosed and wrongly nested elements are closed as
    HTML implies: a block closes an open paragraph, an end tag closes what is
    open inside its element, an end tag without a start is nothing."""
    root = Node("#root")
    stack = [root]
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            stack[-1].inner.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        if tag in BLOCK:
            _close(stack, {"p"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag])
        node = Node(tag, *_names(m[3] if m[3] is not None else m[6] or ""))
        stack[-1].inner.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            node.inner.append(page[at:end.start()] if end else page[at:])
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page):
        stack[-1].inner.append(page[at:])
    return root


def _close(stack: list[Node], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in BLOCK and stack[k].tag not in ("p", "li", "dt", "dd", "td", "th", "tr"):
            return


def _is_root(n: Node) -> bool:
    return n.tag in ("article", "main") or "main" in n.names and n.tag == "div" and not n.named


def _not_text(n: Node, total: int) -> bool:
    """By tag, or by name: never the page or its article, nor what holds most of its text."""
    return n.tag in NOT_TEXT or n.named and not n.root and n.tag not in ("html", "body", "main") and 2 * n.size <= total


def digest(root: Node) -> bool:
    """Hashes every subtree, bottom up, marks the articles and notes what holds
    one; says whether there is any.  An article with a name of NOT_NAMES (a
    reader's comment) counts where the page has no other.  A page without
    articles has its densest text block marked."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.inner if type(c) is Node]
    roots = [n for n in order if _is_root(n)]
    for n in [n for n in roots if n.tag == "main" or not n.named] or roots:
        n.root = True
    for n in reversed(order):
        parts = [n.tag, *n.names]
        for c in n.inner:
            if type(c) is Node:
                parts.append(str(c.hash))
                n.has_root |= c.has_root
                n.size += c.size
                n.para |= c.para or c.tag in PARAGRAPH
                n.own += c.size if c.tag not in BLOCK else 0
            elif s := " ".join(c.split()):
                parts.append(s)
                n.size += len(s)
                n.own += len(s)
        n.has_root |= n.root
        if n.tag in NOT_TEXT:
            n.size = n.own = 0
        n.hash = xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)
        if n.hint:
            n.shape = xxhash.xxh64_intdigest("\x1e".join(("shape", n.tag, *(x for x in n.names if not x.isdigit())))) - (1 << 63)
    if not root.has_root:
        _mark_densest(root)
        return False
    return True


def _mark_densest(root: Node) -> None:
    """Marks the block with most text in its own paragraphs, each character
    twice, and outside of blocks, and what holds it."""
    best, most, todo = [], 0, [(root, None)]
    while todo:
        n, up = todo.pop()
        if n is not root and (_not_text(n, root.size) or n.tag == "header" or n.tag in CONTENT):
            continue
        at = (n, up)
        if n is root or n.tag in BLOCK:
            score = n.own + 2 * sum(c.size for c in n.inner if type(c) is Node and c.tag in PARAGRAPH)
            if score > most:
                best, most = at, score
        todo += [(c, at) for c in reversed(n.inner) if type(c) is Node]
    if best:
        best[0].root = True
    while best:
        best[0].has_root, best = True, best[1]


def _may_go(n: Node, inside: bool, marked: bool) -> bool:
    """Whether a subtree is deleted as a template.  Inside the article, or the
    densest block, content and what merely wraps content stay."""
    if n.tag not in CANDIDATES or n.root or n.has_root and not (inside and marked):
        return False
    wraps = n.para and not any(type(c) is str and c.strip() for c in n.inner)
    return not (inside and (n.tag in CONTENT or wraps))


def _may_go_by_shape(n: Node) -> bool:
    """Whether a subtree is deleted if its tag and names recur on the host, whatever
    its text and size: reader comments, sidebars, related articles."""
    return n.hint and not n.root and not n.has_root and n.tag not in ("html", "body", "main")


def candidates(page: str) -> tuple[int, list[int]]:
    """A hash of the main content (of the whole page, if no article is marked)
    and those of the subtrees that may be templates, each once."""
    root = parse(page)
    marked = digest(root)
    out, mains, todo = set(), [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        if _may_go(n, inside, marked):
            out.add(n.hash)
        if _may_go_by_shape(n):
            out.add(n.shape)
        if n.root and not inside:
            mains.append(n.hash)
        todo += [(c, inside or n.root) for c in n.inner if type(c) is Node]
    key = xxhash.xxh64_intdigest(" ".join(map(str, sorted(mains)))) - (1 << 63) if marked else root.hash
    return key, sorted(out)


def main_text(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text without the subtrees in ``templates``; blocks joined by \\n."""
    root = parse(page)
    marked = digest(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            s = " ".join(htmllib.unescape("".join(line)).split())
            if s:
                blocks.append(s)
            line.clear()

    # (node or text or None for the end of a block, whether its text counts, inside the article or densest block)
    todo: list[tuple] = [(root, not marked, False)]
    while todo:
        n, counts, inside = todo.pop()
        if n is None:
            flush()
        elif type(n) is str:
            if counts:
                line.append(n)
        else:
            # what holds an article is looked into, unless it is inside one itself
            if not n.has_root or inside and marked:
                if _not_text(n, root.size) or not marked and n.tag == "header":
                    continue
            if n.hash in templates and _may_go(n, inside, marked) or n.shape in templates and _may_go_by_shape(n):
                flush()
                continue
            here = inside or n.root
            if n.tag == "br":
                line.append(" ")
            if n.tag in BLOCK:
                flush()
                todo.append((None, False, here))
            todo += [(c, counts or n.root, here) for c in reversed(n.inner)]
    flush()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def template_hashes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(page_id, host, gone): the hashes of each page's template subtrees.

    Counts are combined on the map side, so a menu on a third of all pages is
    one row a task; pages of a hot host are spread over the hashes."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [candidates(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k for k, _ in found], pa.int64()),
                                              pa.array([h for _, h in found], pa.list_(pa.int64()))],
                                             names=["page_id", "host", "main", "h"])

    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("t"))
    found = stage(rows.mapInArrow(run, f"page_id {kind}, host string, main bigint, h array<bigint>"), "subtrees")
    each = found.select("page_id", "host", F.explode("h").alias("h"))
    # copies of a page's main content count once
    once = found.groupBy("host", "main").agg(F.min("h").alias("h"))
    n_host = once.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    often = (once.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_pages)
                 .join(n_host, "host").filter(F.col("k") >= F.least(F.lit(min_share) * F.col("n"), F.lit(many_pages))).select("host", "h"))
    return each.join(often, ["host", "h"]).groupBy("page_id", "host").agg(F.collect_set("h").alias("gone"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null or empty html has an empty text; a null url belongs to the host '';
    repeated rows give repeated results and count as one page; an empty table
    gives no rows; other columns are not read.  Pages of any size are read whole.
    """
    gone = template_hashes(pages, id_col, url_col, html_col, **limits)
    side = gone.select(F.col("page_id").alias("g_id"), F.col("host").alias("g_host"), "gone")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("t"), host(F.col(url_col)).alias("host"))
    rows = rows.join(side, F.col("page_id").eqNullSafe(F.col("g_id")) & (F.col("host") == F.col("g_host")), "left")
    kind = pages.schema[id_col].dataType.simpleString()
    link = pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py(), set(g.as_py() or ())) for t, g in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return (rows.select("page_id", "url", "t", "gone").mapInArrow(run, f"page_id {kind}, url {link}, text string")
                .withColumn("n_chars", F.length("text").cast("long")))
