"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: an element's tags and classes from the root. Each
node has a distribution of contents and one of child sequences (its presentation) over the host's pages; its
importance is the normalised entropy of the two. A branch whose importance is low looks and reads the same on
page after page: it is removed from every page of the host. A page's own marks are the prior of that importance:
1 within a marked article or around it, 0 beside it, 0.5 where a page marks none; the prior counts as a few pages,
so marks decide on a host with one page and the tree decides on others, within an article too. Elements that name
themselves as something other than the article (menus, forms, adverts, scripts and so on) go by name: their words
change from page to page like the article's, so entropy cannot tell them; within a marked article only containers whose
whole class says so. What remains is decoded and cut into blocks.

Edge cases. A null page counts as empty, and its text is empty. A page without a host is judged by its elements
alone. Pages of a host that say the same count once in its tree. Unclosed elements end with their parent or the page;
a broken tag at the end is dropped. Repeated rows are extracted each; ties cannot occur. Extra columns are not read.
No text is cut.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import arrow_map, stage
from loomstone.llm.urls import url_parts

#: A branch that is the same on that many pages goes even from a marked article; where none is marked, on a third of them.
LEAST_PAGES = 10
LOW_IMPORTANCE = 0.25
PRESENTATION_WEIGHT = 0.1
#: Most (host, style node) rows of the removal table that are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST_ROWS = 20_000
SALTS = 16

# fixed values: elements by their kind
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg"}
OTHER = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "object", "canvas", "head", "input"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "menu", "dialog",
}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
#: Within a marked article a name counts only on a container and as a whole class; other names are the article's own.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "details"}
INNER_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "comment-list", "disqus", "sidebar", "sponsored", "newsletter", "cookie-notice", "nav", "navigation", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
WORDS = re.compile(r"[^a-z0-9]+")


@dataclass
class Node:
    """An open element: its style path, whether its text counts, whether it lies in the marked article."""

    tag: str
    path: int
    dropped: bool
    article: bool
    parent: Node | None = None
    children: int = 0
    content: int = 0
    around: bool = False
    verdict: bool = True  # of main_text, which sees parents before their children


@dataclass
class Page:
    """Blocks in page order with their element, and the style of bare text beside a marked article; the elements, parents
    first; (path, content, presentation, prior) of each that isn't named as something else; a digest of the whole."""

    blocks: list[tuple[str, Node, int | None]] = field(default_factory=list)
    tree: list[Node] = field(default_factory=list)
    marked: bool = False
    nodes: list[tuple[int, int, int, float]] = field(default_factory=list)
    mark: int = 0


BITS = (1 << 62) - 1


def digest(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & BITS


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): (a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def names_other(tag: str, own: dict[str, str], in_article: bool) -> bool:
    """Does the element say that it isn't the article? A header within the article is its heading."""
    if tag in OTHER or (tag == "header" and not in_article):
        return True
    if not own:
        return False
    if own.get("role") in ROLES or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if tag in ("html", "body", "article", "main") and not (in_article and tag == "article"):
        return False
    if in_article:
        return tag in (*CONTAINERS, "article") and not INNER_NAMES.isdisjoint(own.get("class", "").split())
    return not NAMES.isdisjoint(WORDS.split(f"{own.get('class', '')} {own.get('id', '')}"))


def parse(source: str) -> Page:
    page, stack = Page(), [Node("", 0, False, False)]
    page.tree.append(stack[0])
    text: list[str] = []
    blocks: list[tuple[str, int, Node]] = []
    nodes: list[Node] = []

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                mark, top = digest(block), stack[-1]
                if not top.dropped:
                    blocks.append((block, mark, top))
                    n = top if top.article else None
                    while n is not None and not n.around:
                        n.around, n = True, n.parent
                top.content = (top.content * 31 + mark) & BITS

    def close() -> None:
        flush()
        n = stack.pop()
        if n.content:  # a parent's content is its blocks' and its children's
            n.parent.content = (n.parent.content * 31 + n.content + 1) & BITS
        if not n.dropped:
            nodes.append(n)

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        if not m:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCKS or tag in OTHER:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        close()
                    break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at) if not rest.rstrip().endswith("/") else None
            at = stop.end() if stop else (at if rest.rstrip().endswith("/") else end)
            text.append(" ")
            continue
        if tag in BLOCKS or tag in OTHER:
            flush()
            # a block ends an open paragraph, an item the item before it
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag not in ("b", "i", "a", "span", "em", "strong", "p"):
                    break
        elif tag == "br":
            text.append("\n")
        own, top = attributes(rest), stack[-1]
        if tag in VOID or rest.rstrip().endswith("/"):
            top.children = digest(top.children, tag)
            continue
        other = names_other(tag, own, top.article)
        if tag not in BLOCKS and tag not in OTHER and not other:
            continue  # inline elements hold no blocks of their own
        if other:
            flush()
        style = f"{tag}.{own.get('class', '')}" + ("#main" if own.get("role") == "main" else "")
        top.children = digest(top.children, style)
        stack.append(Node(tag, digest(top.path, style), top.dropped or other, top.article or tag in ("article", "main") or own.get("role") == "main", top))
        page.tree.append(stack[-1])
    while len(stack) > 1:
        close()
    flush()
    page.marked = marked = stack[0].around
    page.mark = digest(stack[0].content, stack[0].children)
    page.nodes = [(n.path, n.content, n.children, 0.5 if not marked else float(n.article or n.around)) for n in nodes]
    for block, mark, top in blocks:
        bare = None
        if marked and not top.article and top.around:  # bare text between branches
            bare = digest(top.path, "#text")
            page.nodes.append((bare, mark, 0, 0.0))
        page.blocks.append((block, top, bare))
    return page


def main_text(page: Page, low: set[int], high: set[int] = frozenset()) -> str:
    """The blocks less removed branches; beside a marked article only branches that the tree found important stay."""
    for n in page.tree[1:]:
        n.verdict = n.parent.verdict and n.path not in low and (not page.marked or n.article or n.around or n.path in high)
    return "\n".join(b for b, top, bare in page.blocks if top.verdict and (bare is None or bare in high))


def importance_table(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW_IMPORTANCE) -> DataFrame:
    """(host, path, important) of the branches to remove, and of those beside a marked article to keep.

    Both were met on two pages at least, so the table grows with templates. A host's contents are counted before
    they meet, so a hot host spreads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple] = set()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(source)
                seen: dict[int, tuple[int, int, float]] = {}
                for path, content, children, prior in page.nodes:
                    a, b, c = seen.get(path, (0, 0, 0.0))
                    seen[path] = (a * 31 + content & BITS, b * 31 + children & BITS, max(c, prior))
                rows.update((host, path, page.mark, *rest) for path, rest in seen.items())
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), *[pa.int64()] * 4, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "path", "mark", "content", "children", "prior"])

    met = arrow_map(pages.where("host <> ''").select("host", "html"), run, "host string, path long, mark long, content long, children long, prior double").distinct()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("content", "children"))])
    values = met.select("host", "path", "prior", F.inline(kinds)).groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), F.sum("prior").alias("prior"), F.min("prior").alias("least"))
    log_n = F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    entropy = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), (F.log(F.sum("n").cast("double")) - log_n).alias("h"), (F.sum("prior") / F.sum("n")).alias("prior"), F.min("least").alias("least"))
    scored = entropy.where("pages > 1").withColumn("h", F.col("h") / F.log(F.col("pages").cast("double")))
    weight = F.when(F.col("kind") == 1, PRESENTATION_WEIGHT).otherwise(1 - PRESENTATION_WEIGHT)
    held = (least_pages - 1) * low / (1 - low)  # pages that the prior counts as
    node = scored.groupBy("host", "path").agg(F.sum(F.col("h") * weight).alias("h"), F.max("pages").alias("pages"), F.max("prior").alias("prior"), F.min("least").alias("least"))
    importance = F.round((F.col("pages") * F.col("h") + held * F.col("prior")) / (F.col("pages") + held), 9)
    return node.select("host", "path", (importance >= low).alias("important"), "least").where("not important or least = 0").select("host", "path", "important")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least_pages: int = LEAST_PAGES, low: float = LOW_IMPORTANCE) -> DataFrame:
    """key, url, text, n_chars for every row."""
    pages = url_parts(df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("html")), "url").drop("path")
    table = stage(importance_table(pages, least_pages, low), "style-tree")
    # one row a host: as many paths as its templates have, not its pages
    removed = table.groupBy("host").agg(*[F.collect_set(F.when(c, F.col("path"))).alias(k) for k, c in (("low", ~F.col("important")), ("high", F.col("important")))])
    if table.count() <= MAX_BROADCAST_ROWS:
        joined = pages.join(F.broadcast(removed), "host", "left")
    else:
        salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("url", "key"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, sources = (batch.column(k).to_pylist() for k in (2, 3, 4))
            texts = [main_text(parse(s), set(x or ()), set(y or ())) for s, x, y in zip(sources, lows, highs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=["key", "url", "text", "n_chars"])

    kind = pages.schema["key"].dataType.simpleString()
    return arrow_map(joined.select("key", "url", "low", "high", "html"), run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)


def op6_site_style_tree(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
