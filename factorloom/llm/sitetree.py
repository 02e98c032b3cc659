"""Main text of web pages by a site style tree.

The DOMs of a host are merged: a node is the path of structural elements with their
classes.  The importance of every node is the entropy of its content over the host's
distinct pages, relative to the greatest possible (text that every page repeats has 0,
text that no two pages share has 1), and to a tenth that of its presentation, the layout
of the blocks beside it.  A role is a prior: 0 for navigation, adverts, notices, forms and
footers, 1 for article bodies.  Nodes under ``LOW`` are cut from each page; the rest is
its text.  Adverts and comments may be unique as well, so entropy cannot tell them from
an article: comments always go, and other nodes of role 0 outside an article go unless
the page would have no text without them.  An article that would go whole stays.

Statistics are counted by (host, node, content, page) and combined before the shuffle, so
that a host with a third of all pages meets no task whole.

Defined results: a null html is empty and its text is empty; equal pages of a host have
equal texts; a host with fewer than ``MIN_PAGES`` distinct pages is judged by roles
alone; a null url is a host of its own; an empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import only, read_table, small_batches, written

LOW = 0.3
MIN_PAGES = 4
#: Share of content in a node's importance; the rest is presentation.
CONTENT = 0.9
#: Weights of the priors against a host's evidence: of role 1, and of role 0.
MAIN_PRIOR, LOW_PRIOR = 0.25, 1.0
#: Judged nodes that may be broadcast; beyond, they are joined by host.
BROADCAST_NODES = 100_000

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_PLAIN = re.compile(r"[^\"'>]*")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Tags with unbalanced quotes after which quotes of a page are no longer heeded: its time stays linear.
_BROKEN = 16

# Elements that begin a block, elements with a role, and class words with a role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LOW_TAGS = frozenset("nav footer aside form menu dialog head search fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
LOW_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related "
    "recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements whose content is no text; those that an unfinished one hides the rest of the page.
_UNSEEN = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style template title textarea noscript svg iframe select button".split()}
_TO_THE_END = frozenset("script style title textarea".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _role(tag: str, words: set[str], inside: bool) -> int | None:
    """0 or 1 where presentation tells the importance of an element, else None."""
    if tag in LOW_TAGS or (tag == "header" and not inside):
        return 0
    # An article may bear such a word in its own class.
    if words & LOW_WORDS and tag not in ("body", "html") and not (tag in MAIN_TAGS and not words & {"comment", "comments"}):
        return 0
    return 1 if tag in MAIN_TAGS else None


def pieces(source: str) -> Iterator[tuple[str, bool, str]]:
    """Text ("", False, text) and tags (name, whether it ends one, attributes) of a page, in time linear in its length.

    Comments, declarations and the content of unseen elements are left out; a "<" that begins no
    tag is text, as is everything after the last ">".
    """
    at, i, last, broken = 0, 0, source.rfind(">"), 0
    absent: set[str] = set()
    while (j := source.find("<", i)) >= 0 and j < last:
        mark = source[j + 1]
        name = _NAME.match(source, j + 2 if mark == "/" else j + 1)
        if source.startswith("<!--", j):
            end = source.find("-->", j + 4)
            if at < j:
                yield "", False, source[at:j]
            at = i = len(source) if end < 0 else end + 3
            continue
        if mark in "!?":
            name, end = None, source.find(">", j)
        elif name is None:
            i = j + 1
            continue
        else:
            end, p = -1, name.end()
            while broken < _BROKEN:
                p = _PLAIN.match(source, p).end()
                if p > last:
                    broken += 1
                    break
                if source[p] == ">":
                    end = p
                    break
                close = source.find(source[p], p + 1) if source[p] not in absent else -1
                if close < 0:
                    absent.add(source[p])
                p = p + 1 if close < 0 else close + 1
            if end < 0:
                end = source.find(">", name.end())
        if at < j:
            yield "", False, source[at:j]
        at = i = end + 1
        if name is None:
            continue
        tag, attrs = name.group().lower(), source[name.end() : end]
        closer = _UNSEEN.get(tag)
        if closer and mark != "/" and not (tag == "svg" and attrs.endswith("/")):
            found = closer.search(source, at) if tag not in absent else None
            if found:
                at = i = found.end()
            else:
                absent.add(tag)
                if tag in _TO_THE_END:
                    at = i = len(source)
            continue
        yield tag, mark == "/", attrs
    if at < len(source):
        yield "", False, source[at:]


class Block(NamedTuple):
    """A block of text: its node and its parent's, its role, whether it is in an article, among comments, and the text."""

    node: int
    parent: int
    role: int | None
    inside: bool
    comment: bool
    text: str


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


_ROOT = ("", 0, 0, None, False, False)


def blocks(source: str) -> list[Block]:
    """The blocks with text of a page, in order.  A node is the hash of its path of elements with their classes."""
    out: list[Block] = []
    stack = [_ROOT]  # tag, node, parent, role (0 is inherited by all below), inside, comment
    opened: dict[str, int] = {}
    held: list[str] = []

    def close():
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Block(*stack[-1][1:], text))

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for tag, ends, rest in pieces(source):
        if not tag:
            held.append(rest)
            continue
        if tag in _VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                held.append(" ")
            continue
        block = tag in BLOCKS
        if ends:
            if opened.get(tag):
                if block:
                    close()
                    while pop() != tag:
                        pass
                elif stack[-1][0] == tag:
                    close()
                    pop()
            elif block:
                close()
            continue
        names = [b or c or d or "" for _, b, c, d in _NAMES.findall(rest)] if "=" in rest else []
        words = {w for n in names for w in _SPLIT.split(n.lower())}
        if block:
            close()
            while stack[-1][0] == "p":
                pop()
            if tag in ("li", "td", "th", "tr", "dt", "dd") and stack[-1][0] == tag:
                pop()
        _, node, _, above, inside, comment = stack[-1]
        role = 0 if above == 0 else _role(tag, words, inside)
        if not block and role != 0:
            continue
        if not block:
            close()
        if role is None:
            role = above
        label = tag + "".join("." + re.sub(r"\d+", "0", n) for n in names)
        stack.append((tag, _hash(label, node), node, role, inside or tag in MAIN_TAGS, comment or bool(words & COMMENT_WORDS)))
        opened[tag] = opened.get(tag, 0) + 1
    close()
    return out


def _host(url: str | None) -> str | None:
    if url is None:
        return None
    return url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].split("@")[-1].lower()


def style_tree(pages: DataFrame) -> DataFrame:
    """host, node, n_pages, importance of all nodes."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen: dict[int, list[str]] = {}
                layout: dict[int, list[str]] = {}
                above: dict[int, int] = {}
                for x in blocks(text or ""):
                    seen.setdefault(x.node, []).append(x.text)
                    layout.setdefault(x.parent, []).append(str(x.node))
                    above[x.node] = x.parent
                looks = {p: _hash(" ".join(nodes)) for p, nodes in layout.items()}
                page = _hash(text or "")
                for node, parts in seen.items():
                    for c, v in zip(cols, (_host(url), node, _hash(" ".join(parts)), looks[above[node]], page), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["host", "node", "content", "look", "page"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    # Equal pages count once.
    schema = "host string, node long, content long, look long, page long"
    each = pages.select("url", "html").mapInArrow(run, schema).distinct()
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("look").alias("v"))))
    counts = each.select("host", "node", kinds.alias("x")).groupBy("host", "node", "x.kind", "x.v").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n") * F.log("n")).otherwise(0.0))
    n_pages = F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0))
    nodes = counts.groupBy("host", "node").agg(n_pages.alias("n_pages"), of(0).alias("s"), of(1).alias("p"))
    most = F.log("n_pages")
    entropy = lambda c: (most - F.col(c) / F.col("n_pages")) / most
    mixed = F.lit(CONTENT) * entropy("s") + F.lit(1 - CONTENT) * entropy("p")
    return nodes.select("host", "node", "n_pages", F.when(F.col("n_pages") > 1, mixed).otherwise(1.0).alias("importance"))


def main_text(source: str, known: dict[int, float]) -> str:
    """The text of a page; ``known`` has the importance of its host's nodes."""
    kept, article, rest = [], [], []
    for x in blocks(source):
        e = known.get(x.node)
        if x.role == 0 and (x.comment or e is None):
            continue
        if x.role == 0:
            if (e / (1 + LOW_PRIOR)) >= LOW:
                (kept if x.inside else rest).append(x.text)
            continue
        if x.inside:
            article.append(x.text)
        if e is None or (e if x.role is None else (e + MAIN_PRIOR) / (1 + MAIN_PRIOR)) >= LOW:
            kept.append(x.text)
    return " ".join(kept or article or rest)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    src = only(pages, page_id="long", url="string", html="string")
    small_batches(src.sparkSession, 128)
    judged = written(style_tree(src).where(F.col("n_pages") >= MIN_PAGES).select("host", "node", "importance"), "nodes")
    def batch(b, texts):
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = "page_id long, url string, text string"
    if judged.count() <= BROADCAST_NODES:
        by_host: dict = {}
        for r in judged.collect():
            by_host.setdefault(r.host, {})[r.node] = r.importance
        shared = src.sparkSession.sparkContext.broadcast(by_host)

        def run(batches):
            for b in batches:
                urls, sources = b.column(1).to_pylist(), b.column(2).to_pylist()
                yield batch(b, [main_text(x or "", shared.value.get(_host(u), {})) for u, x in zip(urls, sources, strict=True)])

        return src.mapInArrow(run, schema)

    # Each page gets its own nodes alone: looked up by (host, node), so that no host is dealt whole.
    rows = written(src.withColumn("row", F.monotonically_increasing_id()), "pages")

    def nodes(batches):
        for b in batches:
            ids, hosts, found = [], [], []
            for row, url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                some = {x.node for x in blocks(text or "")}
                ids += [row] * len(some)
                hosts += [_host(url)] * len(some)
                found += some
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(found, pa.int64())], names=["row", "h", "node"])

    def look(batches):
        for b in batches:
            sources, known = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield batch(b, [main_text(x or "", {k["node"]: k["importance"] for k in ks or ()}) for x, ks in zip(sources, known, strict=True)])

    own = rows.select("row", "url", "html").mapInArrow(nodes, "row long, h string, node long")
    own = own.withColumnRenamed("node", "n").join(judged, F.col("h").eqNullSafe(F.col("host")) & (F.col("n") == F.col("node")))
    per_page = own.groupBy("row").agg(F.collect_list(F.struct("node", "importance")).alias("known"))
    return rows.join(per_page, "row", "left").select("page_id", "url", "html", "known").mapInArrow(look, schema)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
