"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags and classes are one node of
the host's style tree. A node carries how many pages have it, the presentation styles it takes (which
children follow each other), and its content (the texts it holds). Importance is an entropy:

- presentation: the entropy of a node's styles over its pages, to base m, the number of pages. A node
  that looks alike on all pages has importance 0, one that looks different on each has 1;
- content: 1 minus the mean entropy of the node's texts. A text that stands on all m pages has entropy
  log_m(m) = 1, one that stands on one page has 0.

A node on a single page has importance 1. A branch is noise if neither its top nor any node below it is
important. A page is cleaned by dropping the noise branches of its host, after the branches whose tag,
role, class or id names them as something other than the article. If a page marks its article, what
stands outside is dropped too, and only container branches inside it can be noise: a headline or
paragraph is part of the text even where a second page carries a copy of the article.

Style trees are built from counts: a page sends one row per node, style and text digest, and pages with
the same content count once, so copies do not make an article look like a template. A host with a third
of all pages is pre-aggregated where its pages lie. Noise lists are short; they meet the pages by a
broadcast if they are measured to be small and else by a join that deals each host over salts. Pages
themselves are not shuffled for a broadcast and are parsed twice instead of being stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.tables import Scratch

THRESHOLD = 0.3
LEAST_PAGES = 3  # pages with a node from which its entropy tells anything
BROADCAST_BYTES = 16_000_000
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALWAYS_HIDDEN = frozenset(
    "script style noscript template head title iframe object svg canvas audio video button select option textarea".split())
HIDDEN = frozenset("form input label fieldset nav footer aside menu dialog".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 "
    "header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul nav footer aside caption".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr table ul ol dl figure figcaption "
                      "b i em strong a span code sub sup small u s q cite abbr time mark br".split())
# Elements that end an open one of the same group.
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()),
          "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
          "th": frozenset("td th".split()), "option": frozenset("option".split())}
STOPS_CLOSING = frozenset("ul ol dl table article section div body main blockquote".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs sidebar aside rail widget widgets "
    "footer foot header masthead site-header page-header cookie cookies consent gdpr notice notices alert disclaimer "
    "popup modal overlay newsletter subscribe subscription signup login register search searchbox share sharing social "
    "related recommended recommendations comment comments reply replies respond disqus discussion pagination pager "
    "copyright legal skip hidden form tags meta byline-share print".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NEGATIONS = frozenset("has with no without".split())
COMMENT_NAMES = frozenset("comment comments reply replies".split())
ARTICLE_NAMES = frozenset("article articlebody article-body post-content entry-content main-content".split())
NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(
    r"""(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop)"""
    r"""(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "noise", "article", "_key")

    def __init__(self, tag: str, attributes: dict, parent: "Node | None"):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.noise = self.article = False
        self._key: int | None = None

    @property
    def key(self) -> int:
        """The node's path of tags and classes."""
        if self._key is None:
            classes = ".".join(sorted(self.attributes.get("class", "").lower().split()))
            above = self.parent.key if self.parent is not None else 0
            self._key = _digest(f"{above} {self.tag}.{classes}")
        return self._key

    def names(self) -> list[str]:
        return f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}".split()

    def named_noise(self) -> bool:
        """Whether a name as a whole, or its first or last part, says that this is not the article."""
        if not self.attributes:
            return False
        for name in self.names():
            parts = [p.lower() for p in NAME_PARTS.split(name) if p]
            if name.lower() in NOISE_NAMES:
                return True
            if parts and {parts[0], parts[-1]} & NOISE_NAMES and not set(parts) & NEGATIONS:
                return True
        role = self.attributes.get("role", "").lower()
        return role in NOISE_ROLES or "hidden" in self.attributes or self.attributes.get("aria-hidden") == "true"

    def opens_article(self) -> bool:
        if self.tag in ("article", "main"):
            return not COMMENT_NAMES.intersection(n.lower() for n in self.names())
        return bool(self.attributes) and (
            self.attributes.get("role", "").lower() in ("main", "article")
            or bool(ARTICLE_NAMES.intersection(n.lower() for n in self.names()))
            or self.attributes.get("itemprop", "").lower() == "articlebody")


def _judge(root: Node) -> None:
    """Set ``noise`` and ``article``.

    If names would drop every article of a page (a form or a ``content-menu`` around it all), a branch
    that holds one is not noise.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    opens = [n for n in order if n.opens_article()]
    _mark(order, set())
    if opens and not any(n.article for n in opens):
        holds = set()
        for node in opens:
            while node is not None:
                holds.add(id(node))
                node = node.parent
        _mark(order, holds)


def _mark(order: list[Node], holds: set[int]) -> None:
    for node in order:
        within = node.parent is not None and node.parent.article
        under = node.parent is not None and node.parent.noise
        if node.tag in ("html", "body", "#root"):
            named = False
        elif node.tag in ALWAYS_HIDDEN:
            named = True
        elif node.tag in ("article", "main"):
            named = not node.opens_article()
        else:
            named = id(node) not in holds and (
                node.tag in HIDDEN or (node.tag == "header" and not within)
                or (node.named_noise() and not node.opens_article()))
        node.noise = under or named
        node.article = not node.noise and (within or node.opens_article())


def dom(html: str) -> Node:
    """A forgiving DOM: unclosed and stray tags never lose text."""
    root = top = Node("#root", {}, None)
    head: Node | None = None
    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        text = html[at:found.start() if found else end]
        if text:
            top.children.append(unescape(text))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:  # a comment or declaration
            continue
        tag = tag.lower()
        if found[1]:
            node = top
            while node.parent is not None:
                if node.tag == tag:
                    top = node.parent
                    head = None if tag in ("head", "html") else head
                    break
                if tag not in BLOCKS and node.tag in BLOCKS:
                    break  # a stray inline end tag does not close a block
                node = node.parent
            continue
        if head is not None and (tag in BLOCKS or tag == "body"):
            top, head = head.parent, None  # a head that was never closed
        closes = CLOSES.get(tag) or (CLOSES["p"] if tag in BLOCKS else None)
        node = top
        while closes and node.parent is not None and node.tag not in STOPS_CLOSING:
            if node.tag in closes:
                top = node.parent
                break
            node = node.parent
        rest = found[3]
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        node = Node(tag, attributes, top)
        top.children.append(node)
        if tag == "head":
            head = node
        if tag in RAW:
            closing = RAW[tag].search(html, at)
            at = closing.end() if closing else end
        elif tag not in VOID:
            top = node
    _judge(root)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, list[Node]]]:
    """Nodes with their ancestors, in page order, without the branches that are noise by name."""
    stack = [(root, [])]
    while stack:
        node, above = stack.pop()
        yield node, above
        inner = above + [node]
        for child in reversed(node.children):
            if isinstance(child, Node) and not child.noise:
                stack.append((child, inner))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def style_rows(html: str) -> list[tuple[int, str, int, list[int]]]:
    """``(node, kind, value, ancestors)`` of a page: which nodes it has, their styles and their texts."""
    rows = {}
    for node, above in _walk(dom(html)):
        chain = [a.key for a in above if a.parent is not None]
        style, content = [], False
        for child in node.children:
            if isinstance(child, Node):
                if not style or style[-1] != child.key:
                    style.append(child.key)
            elif text := " ".join(child.split()):
                rows[node.key, "content", _digest(text)] = chain
                content = True
        if node.parent is not None:
            rows[node.key, "node", 0] = chain
            if style and not content:
                rows[node.key, "style", xxhash.xxh64_intdigest(np.array(style, np.uint64).tobytes())] = chain
    return [(*key, chain) for key, chain in rows.items()]


def blocks_of(html: str | None, noise: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of the page's main text, without the noise branches of its host.

    If that leaves nothing, the entropy of the host is not used for this page.
    """
    root = dom(html or "")
    found = _blocks(root, noise)
    return found if found or not noise else _blocks(root, frozenset())


def _blocks(root: Node, noise: frozenset[int]) -> list[str]:
    marked = any(n.article for n, _ in _walk(root))
    out: list[list[str]] = [[]]
    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, tuple):
            out[-1].append(item[0])
        elif item.noise or (item.key in noise and not (marked and item.tag in TEXT_TAGS)
                            and item.tag not in ("article", "main")):
            out[-1].append(" ")
        else:
            block = item.tag in BLOCKS
            if block:
                stack.append(None)
            for child in reversed(item.children):
                if isinstance(child, Node):
                    if item.tag == "header" and item.article and not re.fullmatch("h[1-6]|div|hgroup|span", child.tag):
                        continue  # of an article's own header only the headline is text
                    stack.append(child)
                elif item.article or not marked:
                    stack.append((child,))
            if item.tag == "br":
                out[-1].append(" ")
            if block:
                out.append([])
    texts = (" ".join("".join(parts).split()) for parts in out)
    return [t for t in texts if t]


def noise_nodes(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, nodes``: the noise branches of each host's style tree. ``pages`` has ``host, html``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, html in zip(batch["host"], batch["html"]):
                found = style_rows(html)
                texts = sorted(v for _, k, v, _ in found if k == "content")
                page = xxhash.xxh64_intdigest(np.array(texts, np.uint64).tobytes())
                out += [(host, n, k, v, page, chain) for n, k, v, chain in found]
            frame = pd.DataFrame(out, columns=["host", "node", "kind", "value", "page", "above"])
            for c in ("node", "value", "page"):
                frame[c] = np.array(frame[c], np.uint64).view(np.int64)
            frame["above"] = [np.array(a, np.uint64).view(np.int64) for a in frame["above"]]
            yield frame

    found = pages.where(F.col("html").isNotNull()).select("host", "html").mapInPandas(
        rows, "host string, node long, kind string, value long, page long, above array<long>")
    counted = (
        found.groupBy("host", "node", "kind", "value", "page").agg(F.any_value("above").alias("above"))
        .groupBy("host", "node", "kind", "value").agg(F.count("*").alias("k"), F.any_value("above").alias("above"))
    )
    logs = F.ln("k")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    nodes = counted.groupBy("host", "node").agg(
        of("node", F.col("k")).alias("m"), of("style", F.col("k")).alias("s"), of("style", F.col("k") * logs).alias("s_log"),
        of("content", F.lit(1)).alias("texts"), of("content", logs).alias("t_log"), F.any_value("above").alias("above"))
    base = F.ln(F.col("m"))
    style = (F.ln("s") - F.col("s_log") / F.col("s")) / base
    content = 1 - F.col("t_log") / F.col("texts") / base
    importance = F.when(F.col("m") < least_pages, F.lit(1.0)).otherwise(
        F.greatest(F.coalesce(style, F.lit(0.0)), F.coalesce(content, F.lit(0.0))))
    branches = (
        nodes.select("host", importance.alias("importance"),
                     F.explode(F.concat(F.array("node"), "above")).alias("node"))
        .groupBy("host", "node").agg(F.max("importance").alias("most")).where(F.col("most") < threshold)
    )
    return branches.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` (``url, html`` and any other columns) with ``text`` and ``n_chars``, which replace such columns.

    Null html, and pages without article text, give the empty string. A null or unreadable url counts as
    a host of its own. Character references are decoded, white space inside a block becomes one space,
    blocks are joined by an empty line. Repeated pages each give a row.
    """
    scratch = Scratch(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    @F.pandas_udf("string")
    def main_text(html: pd.Series, nodes: pd.Series) -> pd.Series:
        none: frozenset[int] = frozenset()
        own = [none if n is None else frozenset(np.asarray(n, np.int64).view(np.uint64).tolist()) for n in nodes]
        return pd.Series(["\n\n".join(blocks_of(h, n)) for h, n in zip(html, own)])

    hosted = pages.select(F.struct(*names).alias("page"), "html", host(F.col("url")).alias("host"))
    noise = scratch.keep(noise_nodes(hosted, threshold))
    size = noise.agg(F.coalesce(F.sum(F.length("host") + F.size("nodes") * 8 + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(noise), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")
        spread = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.coalesce(salt, F.lit(0))).join(spread, ["host", "salt"], "left")
    text = joined.select("page", main_text(F.col("html"), F.col("nodes")).alias("text"))
    return text.select(*[F.col("page")[c].alias(c) for c in names], "text", chars(F.col("text")).alias("n_chars"))


def chars(text: Column) -> Column:
    return F.length(text).cast("long")
