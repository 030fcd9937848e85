"""Main text of web pages, without what a site repeats.

A page is read into a tree of elements (unclosed and wrongly nested tags are closed as browsers do). Every element outside
the prose of an article is hashed with all that is below it; Spark counts on how many pages of a host each hash occurs,
and elements found on ``MANY`` pages, or on ``SHARE`` of a host's pages and ``LEAST`` or more, are site template and go. The same
holds for each section of a host (the first part of the path, if another follows), so that a section's own menu goes. Menus, headers,
footers, sidebars, notices, adverts, forms and comments that their tag, role, class or id names go on any site, as do
scripts, styles and hidden elements. If a page has ``article`` elements, they are its main text, else ``main``, else the
body. Paragraphs and headings of an article are never template: copies of an article on one host are content.

A block is what lies between tags of block elements; its white space becomes one space, character references are
decoded, and blocks are joined by a line feed. Null or empty html gives an empty text. Pages without a host in their url
have no template. Repeated rows are read row by row and count as pages. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import salted_join, stage, table

SHARE = 0.3
LEAST = 5
MANY = 50
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr table tbody thead ul ol dl figcaption figure".split())
BLOCK = PROSE | frozenset("address article aside body center details dialog div fieldset footer form header hgroup hr html legend main menu nav optgroup option section summary caption".split())
ENDS_P = BLOCK - frozenset("td th tr tbody thead body html option optgroup legend summary caption dt dd figcaption".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title nav footer aside form button select textarea input dialog menu".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs
    header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription share sharing social related recommended
    comment comments disqus respond replies form login signup search skip complementary contentinfo banner dialog""".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PARTS = re.compile(r"[^a-z]+")


@dataclass
class Node:
    tag: str
    named: bool = False
    prose: bool = False
    parts: list = field(default_factory=list)
    hash: int = 0


def _is_named(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether tag or attributes say that this is no main text."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main") and not HIDDEN.search(attributes):
        return tag == "article" and bool(attributes) and _names(attributes) & {"comment", "comments"} != set()
    return bool(HIDDEN.search(attributes)) or bool(_names(attributes) & NAMES)


def _names(attributes: str) -> set[str]:
    found = (m[1] or m[2] or m[3] or "" for m in NAMED.finditer(attributes))
    return {x for value in found for x in PARTS.split(value.lower())}


def parse(page: str) -> Node:
    """The tree of a page; parts are texts and nodes in page order."""
    root = Node("html")
    stack, at, articles = [root], 0, 0

    def close(upto: int) -> None:
        nonlocal articles
        articles -= sum(n.tag in ("article", "main") for n in stack[upto:])
        del stack[upto:]

    def nearest(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            found = nearest({tag}, {"table"} if tag not in ("table", "article", "main", "body", "html", "div", "section") else set())
            if found:
                close(found)
            elif tag in BLOCK:
                stack[-1].parts.append(Node(tag))
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and (found := nearest({"p"}, {"button", "table", "td", "th", "article", "section", "div"})):
            close(found)
        if tag in CLOSES and (found := nearest(*CLOSES[tag])):
            close(found)
        node = Node(tag, _is_named(tag, m[3], articles > 0), articles > 0 and tag in PROSE)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            articles += tag in ("article", "main")
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every node before (False) and after (True) what is below it; trees may be deep, so there is no recursion."""
    todo = [(root, False)]
    while todo:
        node, after = todo.pop()
        yield node, after
        if not after:
            todo.append((node, True))
            todo += [(x, False) for x in reversed(node.parts) if isinstance(x, Node)]


def hashed(root: Node) -> list[int]:
    """Hash every subtree; the distinct hashes of those that have text and may be template."""
    found = set()
    for node, after in _walk(root):
        if after:
            inside = [str(x.hash) if isinstance(x, Node) else " ".join(x.split()) for x in node.parts]
            inside = [x for x in inside if x not in ("", "0")]
            if inside:
                node.hash = int.from_bytes(blake2b("\x00".join([node.tag, *inside]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                if not node.prose and not node.named and node.tag not in ("html", "article", "main"):
                    found.add(node.hash)
    return sorted(found)


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text, without named boilerplate and without the subtrees in ``template``."""

    def gone(node: Node) -> bool:
        return node.named or (not node.prose and node.hash in template and node.tag not in ("html", "article", "main"))

    roots: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if gone(node):
            continue
        if node.tag in roots:
            roots[node.tag].append(node)
        if node.tag != "article":
            todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
    blocks, text = [], []

    def end_block() -> None:
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            blocks.append(block)

    for start in roots["article"] or roots["main"][:1] or [root]:
        work: list[Node | str | None] = [start]
        while work:
            x = work.pop()
            if x is None:
                end_block()
            elif isinstance(x, str):
                text.append(x)
            elif x.tag == "br":
                text.append(" ")
            elif not gone(x):
                if x.tag in BLOCK:
                    end_block()
                    work.append(None)
                work += reversed(x.parts)
        end_block()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def section_of(url: Column) -> Column:
    """The first part of a url's path if another part follows, else an empty text."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)/+[^/?#]", 1), F.lit(""))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST, many: int = MANY) -> DataFrame:
    """host, template: the hashes of what recurs on many pages of a host or of a section of it. pages: host, section, html.

    A hash must be on ``many`` pages of the host, or on ``share`` of the pages of the host or a section and on ``least``."""

    @F.arrow_udf("array<long>")
    def elements(column: pa.Array) -> pa.Array:
        return pa.array([hashed(parse(x)) if x else [] for x in column.to_pylist()], pa.list_(pa.int64()))

    known = pages.where("host IS NOT NULL")
    each = known.select("host", "section", F.explode(F.concat(F.array(F.lit(0).cast("long")), elements("html"))).alias("hash"))
    counts = stage(each.groupBy("host", "section", "hash").agg(F.count("*").alias("n")), "subtrees")
    found = []
    for keys, seen in ((["host"], counts.groupBy("host", "hash").agg(F.sum("n").alias("n"))), (["host", "section"], counts)):
        total = seen.where("hash = 0").select(*keys, F.col("n").alias("pages"))
        often = seen.where((F.col("hash") != 0) & (F.col("n") >= least)).join(total, keys)
        found.append(often.where((F.col("n") >= share * F.col("pages")) | (F.col("n") >= many)).select("host", "hash"))
    return stage(found[0].unionAll(found[1]).groupBy("host").agg(F.collect_set("hash").alias("template")), "templates")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row."""

    @F.arrow_udf("string")
    def text_of(column: pa.Array, template: pa.Array) -> pa.Array:
        out = []
        for page, site in zip(column.to_pylist(), template.to_pylist()):
            root = parse(page or "")
            if site:
                hashed(root)
            out.append(main_text(root, frozenset(site or ())))
        return pa.array(out, pa.string())

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"), section_of(F.col(url)).alias("section"))
    joined = salted_join(rows, templates(rows.select("host", "section", "html")), "host", F.coalesce(F.col("page_id"), F.lit(0)))
    return joined.select("page_id", "url", text_of("html", "template").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
