"""Main text of HTML pages, with site templates removed.

Every page is parsed into its element tree and each subtree is hashed. Spark counts, per host, on how many
pages a subtree occurs; subtrees that recur across many pages of their host are deleted, as are elements that
name themselves boilerplate (by tag, role, class or id; only by whole names, inside an article only by unambiguous
ones). What remains of the article and of the main part around it, or of the body where a page marks neither, is its
text. Where a page marks no article, no element that holds more than half of the page's text goes by its class or id
alone, unless it names reader comments, nor does a form that holds as much.

A copied article also recurs. So inside an article a subtree must recur on most pages of a host before it is
deleted, outside on a smaller share.

The counted subtrees are broadcast if their number is below a checked bound, else joined to the pages.

Defined results: a null or empty page, or one without text, has the text ""; broken markup is closed where a
browser would; pages of any length are read whole; equal pages get equal texts, and each of them counts; exactly half
of a page's text is not more than half, and a subtree on exactly the least share of pages is a template; pages without a
host share one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, small_batches

#: A subtree is a host's template from so many pages and this share of them on, outside and inside an article.
LEAST_PAGES, SHARE_OUTSIDE, LEAST_INSIDE, SHARE_INSIDE = 5, 0.1, 20, 0.6
#: Template subtrees that may be broadcast (16 bytes each).
BROADCAST_ROWS = 500_000

#: A comment, a declaration, or the name of a tag; what of a tag follows its name. Quotes delimit only after ``=``, and
#: no part is ever tried twice, so broken markup takes linear time.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/[^a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_REST = re.compile(r"""(?>[^=>]++|=\s*+(?>"[^"]*+"|'[^']*+')?)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
SCOPE = set("article aside body div section main table ul ol dl td th blockquote nav footer header form html".split())
DROPPED_TAGS = set("head script style noscript template iframe svg math canvas audio video object embed form button input select textarea dialog menu nav footer aside title".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words that mark boilerplate outside an article where a whole class name or id is made of them, words
#: of reader comments, and words of place that may stand with either.
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors promo promoted promotion promotions "
    "sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar banner disqus "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login signin paywall "
    "share sharing social related recommended recommendations trending widget widgets pagination pager copyright".split()
)
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "commentlist", "respond"}
PLACE_WORDS = set("left right top bottom upper lower main site page global primary secondary sub mobile desktop fixed sticky side wrapper wrap container box bar block area section list links link buttons button icons items item inner outer row col column slot message text form post posts user reader thread latest all inline body count title".split())
#: Inside an article only whole class names and ids like these mark boilerplate, as any part of a name
#: may be a part of the article (search-results, related-work, discussion).
INSIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising ad-slot adslot ad-banner ad-container adsense adsbygoogle sponsored sponsored-content promo "
    "sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs footer pagination pager toolbar "
    "notice notices cookie-notice cookie-banner cookie-consent consent gdpr popup modal overlay paywall "
    "newsletter newsletter-signup newsletter-form subscribe signup share sharing social share-buttons share-bar social-share social-buttons share-links "
    "related related-posts related-articles related-links recommended disqus disqus-thread disqus_thread".split()
)


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "holds", "size")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.digest, self.holds, self.size = 0, False, 0


_CLOSE_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in RAW}


def parse(page: str) -> Node:
    """The element tree. Text children are strings with their character references decoded."""
    root = Node("", "")
    stack, at = [root], 0
    opened: Counter = Counter()  # open elements by name, so a tag that closes nothing looks at none

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not found:
            return root
        at = found.end()
        if found[2] is None:
            continue
        rest = _REST.match(page, at)
        if not rest:  # a tag that does not end has the rest of the page in it
            return root
        tag, attributes, at = found[2].lower(), rest[0][:-1], rest.end()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        if tag not in INLINE and any(opened[t] > 0 for t in CLOSED_BY):
            for i in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[i].tag, ()):
                    close(i)
                    if stack[-1].tag not in CLOSED_BY:
                        break
                elif stack[i].tag in SCOPE:
                    break
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _CLOSE_RAW[tag].search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1


def _attributes(node: Node) -> dict[str, str]:
    unquoted = lambda v: v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1 else v
    return {k.lower(): entities.unescape(unquoted(v)) for k, v in reversed(_ATTRIBUTE.findall(node.attributes))}


def _made_of(name: str, words: set[str]) -> bool:
    """Whether some of the words, and otherwise only words of place and numbers, make up the name."""
    parts = [w.lower() for w in _NAME.findall(name)]
    return not words.isdisjoint(parts) and all(w in words or w in PLACE_WORDS for w in parts)


def _boilerplate(node: Node, inside: bool, most: bool) -> bool:
    """Whether an element names itself so. One that holds an article is kept, unless it holds reader comments, and one
    that holds most of a page without an article does not go by its class or id."""
    tag = node.tag
    if tag in DROPPED_TAGS and not node.holds and not (most and tag == "form"):
        return True
    if tag == "header" and not inside and not node.holds:
        return True
    if not node.attributes.strip():
        return False
    own = _attributes(node)
    names = {n for k in ("class", "id") for n in own.get(k, "").split()}
    if tag not in ("html", "body") and any(_made_of(n, COMMENT_WORDS) for n in names):
        return True
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower():
        return not node.holds
    if tag in ("html", "body", "main", "article") or node.holds:
        return False
    if own.get("role", "").lower() in DROPPED_ROLES:
        return True
    if inside:
        return not INSIDE_NAMES.isdisjoint(n.lower() for n in names)
    return not most and any(n.lower() in INSIDE_NAMES or _made_of(n, DROPPED_WORDS) for n in names)


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or "role" in node.attributes and _attributes(node).get("role", "").lower() == "main" or "articleBody" in node.attributes


def _order(root: Node) -> list[Node]:
    """All elements, each before what it holds."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if not isinstance(c, str))
    return out


def prepare(page: str) -> tuple[Node, list[Node]]:
    """The tree with the digest of each subtree, and its elements in an order with parents first."""
    root = parse(page)
    nodes = _order(root)
    for node in reversed(nodes):
        parts, node.holds, node.size = [node.tag], False, 0
        for c in node.children:
            if isinstance(c, str):
                if c := " ".join(c.split()):
                    parts.append("t" + c)
                    node.size += len(c) * (node.tag not in RAW)
            else:
                parts.append(f"e{c.digest:x}")
                node.holds |= c.holds or _is_article(c)
                node.size += c.size
        node.digest = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) if len(parts) > 1 else 0
    return root, nodes


def host_of(url: str | None) -> str:
    found = re.match(r"[^:]*://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def key_of(host: str, digest: int) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{digest:x}".encode("utf-8", "surrogatepass")) >> 1


def extract(page: str | None, host: str, outside: set[int] | frozenset, everywhere: set[int] | frozenset) -> str:
    """The main text. The sets hold the keys of template subtrees, those that also count inside articles last."""
    if not page:
        return ""
    root, _ = prepare(page)
    blocks: list[str] = []
    open_: list[str] = []

    def end() -> None:
        if text := " ".join("".join(open_).split()):
            blocks.append(text)
        open_.clear()

    most = lambda node: not root.holds and 2 * node.size > root.size
    tops: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node is not root and _boilerplate(node, False, most(node)):
            continue
        if _is_article(node):
            tops.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for top in tops or [root]:
        work: list = [(top, False)]
        while work:
            node, inside = work.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                open_.append(node)
            elif node.tag in VOID:
                if node.tag == "br":
                    open_.append(" ")
                elif node.tag not in INLINE and node.tag not in ("img", "input", "embed"):
                    end()
            else:
                if node is not top:
                    if _boilerplate(node, inside, most(node)):
                        continue
                    if node.digest and not node.holds and (outside or everywhere):
                        key = key_of(host, node.digest)
                        if key in everywhere or not inside and key in outside:
                            continue
                # Of nested marks the inner one is the article; what stands beside it is kept unless it names itself.
                inside = inside or _is_article(node) and not node.holds
                block = node.tag not in INLINE
                if block:
                    end()
                    work.append((None, inside))
                work.extend((c, inside) for c in reversed(node.children))
        end()
    return " ".join(blocks)


def subtree_keys(page: str | None, host: str) -> set[int]:
    """Keys of the page's subtrees that have text. Those that hold the article are no template."""
    return {key_of(host, n.digest) for n in prepare(page)[1] if n.digest and not n.holds and n.tag not in ("", "html", "head", "body", "article", "main", "title", "script", "style")} if page else set()


def count_subtrees(pages: DataFrame) -> DataFrame:
    """(host, key, pages): on how many pages of its host each subtree occurs; key -1 counts the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(url)
                mark = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass")) >> 1
                counts.update((mark, k) for k in subtree_keys(page, host))
                counts[mark, -1] += 1
            columns = [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["host", "key", "pages"])

    counted = pages.select("url", "html").mapInArrow(run, "host long, key long, pages long")
    return counted.groupBy("host", "key").agg(F.sum("pages").alias("pages"))


def templates(pages: DataFrame) -> DataFrame:
    """(key, everywhere): the template subtrees, and whether they also count inside articles."""
    counted = materialize(count_subtrees(pages).where(f"key = -1 or pages >= {LEAST_PAGES}"))
    hosts = counted.where("key = -1").select("host", F.col("pages").alias("all_pages"))
    both = counted.where("key <> -1").join(hosts, "host")
    inside = (F.col("pages") >= LEAST_INSIDE) & (F.col("pages") >= SHARE_INSIDE * F.col("all_pages"))
    return both.where(F.col("pages") >= SHARE_OUTSIDE * F.col("all_pages")).select("key", inside.alias("everywhere"))


def _texts(pages: DataFrame, value, with_keys: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside, everywhere = value.value if value is not None else (frozenset(), frozenset())
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            texts = []
            for i, (url, page) in enumerate(zip(columns[1], columns[2], strict=True)):
                own = (set(columns[3][i] or ()), set(columns[4][i] or ())) if with_keys else (outside, everywhere)
                texts.append(extract(page, host_of(url), *own))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _with_keys(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Each page with the template keys that occur on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = subtree_keys(page, host_of(url))
                mark = xxhash.xxh64_intdigest(f"{url}\0{page}".encode("utf-8", "surrogatepass")) >> 1
                out[0] += [mark] * len(keys)
                out[1] += keys
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["mark", "key"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [xxhash.xxh64_intdigest(f"{u}\0{p}".encode("utf-8", "surrogatepass")) >> 1 for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], ["page_id", "url", "html", "mark"])

    on_page = pages.select("url", "html").mapInArrow(run, "mark long, key long").distinct().join(found, "key")
    lists = on_page.groupBy("mark").agg(F.collect_list("key").alias("outside"), F.collect_list(F.when(F.col("everywhere"), F.col("key"))).alias("everywhere"))
    return pages.mapInArrow(mark, "page_id long, url string, html string, mark long").join(lists, "mark", "left").select("page_id", "url", "html", "outside", "everywhere")


def main_text(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars per row."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = materialize(templates(pages))
    if found.count() > broadcast_rows:
        return _texts(_with_keys(pages, found), None, True)
    got = found.toPandas()
    keys = got["key"].to_numpy(np.int64)
    value = (frozenset(keys.tolist()), frozenset(keys[got["everywhere"].to_numpy(bool)].tolist()))
    return _texts(pages, pages.sparkSession.sparkContext.broadcast(value), False)
