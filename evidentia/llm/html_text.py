"""Main text of web pages by a site style tree.

A page is a sequence of text blocks, each at a path of block elements (tag, with its class and id words). The pages of a
host are merged: a node is a path; it has the pages that contain it, the child sequences it is presented with, and the
texts it holds. A node's presentation importance is the entropy of its child sequences over its m pages, to base m; a
leaf's content importance is 1 less the mean entropy of its texts over the pages: a text on every page has entropy 1, one
on a single page 0. A node's importance joins
its own presentation's and the mean content importance of the leaves below it: (1 - G**l) * presentation + G**l * content,
for l different child sequences. Each is drawn to 1 by WEIGHT pages' worth, so few pages decide little. Branches that are
below LEAST, with each of their leaves, are removed from each page of the host; nothing else removes text.

What markup says of itself is a prior: leaves below navigation, footers, forms and the like, by tag, role, class or id
words, and leaves outside of a page's article or main element, have PRIOR of their importance, which varying text alone
can't make up for. Pages with and without such an element are two trees of a host. A branch with more than half of the
article's text stays whatever its importance, because near copies on one host would make an article look like boilerplate.
Elements that show no text of a page (scripts, styles, options, hidden ones) are no nodes.

Defined results: a null html is empty; its text is empty. Null or broken urls belong to the host "". Each row gives one
row, repeated rows too. Further columns are ignored. Nothing is cut, however long a page or deep its nesting; a node's
importance counts the leaves of DEEP levels below it, and a removed branch goes with all that it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.runtime import cut, map_arrow, small

#: Weight of presentation, least importance, pages that the prior is worth, what declared noise keeps, levels that count.
G, LEAST, WEIGHT, PRIOR, DEEP = 0.9, 0.35, 2, 0.3, 40

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary svg table tbody td template tfoot th thead title tr ul script style textarea iframe object audio video canvas".split())
#: Elements that show no text of the page; and those that declare noise, header only outside of an article.
SILENT = frozenset("head title script style noscript template svg button select textarea iframe object audio video canvas option input".split())
NOISE = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply respond cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup login share sharing social related recommended widget pagination pager toolbar skip".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html div section article main nav aside footer header td th select".split())


class Page:
    """Nodes of a page in order (path's hash, parent, declared noise, in the main element) and blocks (node, text)."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, int, bool, bool]] = [(0, -1, False, False)]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self.has_main = False
        self.text: list[str] = []
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, silent
        self.read(source)

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            _, node, silent = self.stack[-1]
            if text and not silent:
                self.blocks.append((node, text))
                self.children[node].append("#")

    def open(self, tag: str, attributes: str) -> None:
        _, parent, silent = self.stack[-1]
        path, _, noise, main = self.nodes[parent]
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower()
        if silent or tag in SILENT or hidden:
            self.stack.append((tag, parent, True))
            return
        named = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", at.get("class", "") + " " + at.get("id", "")).lower()) if at else []
        role = at.get("role", "").lower()
        is_main = tag in ("article", "main") or role in ("main", "article")
        declared = tag in NOISE or role in ROLES or tag == "header" and not main
        if not declared and tag not in ("html", "body"):
            declared = any(w in WORDS for w in named) or "header" in named and not main
        name = tag + "".join(f".{w}" for w in named)
        self.children[parent].append(name)
        noise = noise or declared
        main = main or is_main and not noise
        self.has_main |= main
        self.nodes.append((xxhash.xxh3_64_intdigest(f"{path}/{name}") >> 1, parent, noise, main))
        self.children.append([])
        self.stack.append((tag, len(self.nodes) - 1, False))

    def path(self, node: int) -> int:
        """A node's name in its host's tree: pages with and without a main element have different ones."""
        return self.nodes[node][0] ^ self.has_main

    def above(self, node: int) -> list[int]:
        """The paths of a node and its ancestors, DEEP of them."""
        out = []
        while node >= 0 and len(out) < DEEP:
            out.append(self.path(node))
            node = self.nodes[node][1]
        return out

    def doubtful(self, node: int) -> bool:
        """Does markup say that a node isn't main text?"""
        _, _, noise, main = self.nodes[node]
        return noise or self.has_main and not main

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def imply(self, tag: str) -> None:
        """Ends what a new block element ends: an open paragraph, or a list item or cell of the same list or row."""
        if self.stack[-1][0] in CLOSED_BY_BLOCK:
            self.stack.pop()
        if ended := SAME.get(tag):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in ended:
                    del self.stack[k:]
                    return
                if self.stack[k][0] in SCOPE:
                    return

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.match(source, at)
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0][0] != "<" or m[0] == "<":
                    self.text.append(m[0])
                continue
            if m[1]:
                if tag in BLOCK:
                    self.flush()
                    self.close(tag)
            elif tag == "br":
                self.text.append(" ")
            elif tag in BLOCK or tag in RAW:
                self.flush()
                self.imply(tag)
                if tag not in VOID and not (m[3] or "").endswith("/"):
                    self.open(tag, m[3] or "")
                if tag in RAW:  # its text is no markup, and none of it is main text
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else size
                    self.close(tag)
        self.flush()


def chosen(page: Page, low: set[int]) -> list[str]:
    """The page's text blocks, without branches of `low`; a branch with most of the article's text stays."""
    sizes = [0] * len(page.nodes)
    for node, text in page.blocks:
        sizes[node] += len(text) if not page.doubtful(node) else 0
    for node in range(len(sizes) - 1, 0, -1):  # parents stand before their children
        sizes[page.nodes[node][1]] += sizes[node]
    held: dict[int, int] = {}
    for node, size in enumerate(sizes):
        held[page.path(node)] = held.get(page.path(node), 0) + size
    gone = [False] * len(sizes)
    for node in range(len(sizes)):
        parent, path = page.nodes[node][1], page.path(node)
        gone[node] = parent >= 0 and gone[parent] or path in low and not (page.has_main and 2 * held[path] > sizes[0])
    return [text for node, text in page.blocks if not gone[node]]


def host_of(column: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def low_branches(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """host, path of every node of the hosts' style trees whose importance is below `least`."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, path, kind (1 child sequence, 2 text), value, is it doubtful, a leaf's ancestors for kind 2."""
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                rows, seen = {}, set()
                for node, text in page.blocks:
                    rows[page.path(node), 2, signed(xxhash.xxh3_64_intdigest(text))] = (page.doubtful(node), above := page.above(node))
                    seen.update(above)
                first = {page.path(node): node for node in range(len(page.nodes) - 1, -1, -1)}
                rows |= {(p, 1, signed(xxhash.xxh3_64_intdigest(" ".join(page.children[first[p]])))): (False, []) for p in seen}
                out += [(host, *key, *value) for key, value in rows.items()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "path", "kind", "value", "doubtful", "above"])

    rows = map_arrow(pages.select(host_of().alias("host"), "html"), facts, "host string, path bigint, kind int, value bigint, doubtful boolean, above array<bigint>")
    counts = cut(rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), F.max("doubtful").alias("doubtful"), F.max("above").alias("above")))
    drawn = lambda x: (F.col("m") * x + WEIGHT) / (F.col("m") + WEIGHT)
    base = F.log(F.greatest("m", F.lit(2.0)))
    m = counts.filter("kind = 1").groupBy("host", "path").agg(F.sum("n").cast("double").alias("m"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    shape = cut(m.select("host", "path", "m", "styles", drawn((F.log("m") - F.col("nlogn") / F.col("m")) / base).alias("shape")))
    texts = counts.filter("kind = 2").groupBy("host", "path").agg(F.avg(F.log("n")).alias("log_n"), F.max("doubtful").alias("doubtful"), F.max("above").alias("above"))
    worth = F.when(F.col("doubtful"), PRIOR).otherwise(1.0)
    leaf = texts.join(shape.select("host", "path", "m"), ["host", "path"]).select("host", "above", worth.alias("worth"), (worth * drawn(1 - F.col("log_n") / base)).alias("content"))
    content = leaf.select("host", F.explode("above").alias("path"), "worth", "content").groupBy("host", "path").agg(F.avg("content").alias("content"), F.max("content").alias("most"), F.max("worth").alias("worth"))
    share = F.pow(F.lit(G), F.col("styles"))
    importance = (1 - share) * F.col("worth") * F.col("shape") + share * F.col("content")
    return shape.join(content, ["host", "path"]).filter((importance < least) & (F.col("most") < least)).select("host", "path")


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    low = cut(low_branches(pages, least).groupBy("host").agg(F.collect_list("path").alias("low")))  # paths, not pages, of a host

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(chosen(Page(source or ""), set(noise or ()))) for source, noise in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(small(low, weight=F.size("low")), "host", "left").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "low")
    return map_arrow(rows, run, "page_id bigint, url string, text string, n_chars bigint")
