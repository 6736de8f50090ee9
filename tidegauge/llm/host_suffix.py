"""Operator 5: main text of web pages, with a suffix array of each host's token streams.

Markup cuts a page into blocks and decides what it names: blocks inside an
article are text, blocks inside menus, headers, footers, sidebars, forms,
notices, adverts and comments are not. What markup leaves open (a page without
an article) is decided by repetition. The token streams of a host's open and
dropped blocks are put side by side. A suffix that begins with ``shortest``
tokens that a distinct page of the host has, too, goes into the host's suffix
array: sorted by the names of its first 8, 16, 32 and 64 tokens (names of
doubled length, as in prefix doubling), so that suffixes with long common
beginnings are neighbours, whose common length bounds the repeat. Open tokens
that a repeat covers are boilerplate; the runs between them stay. A whole open
block that few pages of the host repeat (two, or the share ``copies``) is a
copied article and stays.

The sort is cut into ranges by name, never by host, so no host stands in one
task, and a menu that all pages of a large host share is aggregated before it is
shuffled. A cut between two neighbours shortens a repeat's known length at most
to ``shortest`` and uncovers nothing, since the suffixes inside the repeat are in
the array themselves. Text inside an article is never dropped for being
repeated: two pages may hold the same article.

A null page gives the empty text, a null address the host ''. Whole pages are
read, whatever their length. Repeated rows are extracted each and count as one
page; two pages of one page_id that differ are two pages. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import join_unique, materialize, small_batches

#: Elements whose content is never text, that are never text outside or inside an article, and that end a block.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes", "noembed"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "object", "head"}
ARTICLE = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role that name what is not the article, and what is.
NOISE = {
    "ad", "ads", "advert", "advertisement", "adsense", "adslot", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "privacy", "promo", "promoted", "recommended",
    "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "topbar", "widget",
}
PAGE_HEAD = {"header", "masthead"}
#: Words that name a part or a place of something. Inside an article only names made of these and the words above drop text.
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "count", "form", "group", "icon", "icons", "inline",
    "inner", "item", "items", "left", "link", "links", "list", "module", "outer", "panel", "post", "posts", "right", "row", "section", "slot", "stories",
    "thread", "top", "unit", "wrap", "wrapper", "zone",
}
#: Words that turn the other words of a class name round, and elements that no class name drops.
NEGATIONS = {"no", "not", "non", "without", "free", "has", "js", "ready", "disabled", "hidden"}
PAGE = {"html", "body", "main"}
STORY = {"article", "articlebody", "entry", "main", "post", "story"}

#: A comment, a declaration, or a tag; a quote opens a value only after an equals sign.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""",
    re.S,
)
NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NOT_WORD = re.compile(r"[^a-z0-9]+")
KEEP, DROP, OPEN = 0, 1, 2
#: Lengths, in multiples of the shortest repeat, by which suffixes are named.
DOUBLED = (2, 4, 8)
EXTRACTED = "page long, page_id long, url string, host string, kinds array<tinyint>, blocks array<string>, open boolean"
SUFFIX = f"page long, at int, name long, {', '.join(f'name{k} long' for k in DOUBLED)}"


def names_of(attributes: str) -> tuple[set[str], set[str], bool]:
    """Words of the element's class, id, role and itemprop; those of names that no word turns round; whether one of these names says noise and nothing else."""
    if "=" not in attributes:
        return set(), set(), False
    every, plain, whole = set(), set(), False
    for name in " ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower().split():
        words = {w for w in NOT_WORD.split(name) if w}
        every |= words | {name}
        if not words & NEGATIONS:
            plain |= words | {name}
            whole = whole or bool(words & NOISE) and words <= NOISE | PARTS
    return every, plain, whole


def weight(tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """(what it adds to the noise level, to the article level). Inside an article a name such as social-history drops nothing."""
    names, plain, whole = names_of(attributes)
    story = bool(names & STORY)
    if tag in PAGE or tag == "article" and not inside:
        return 0, int(tag in ARTICLE)
    if tag in DROPPED or (whole if inside else plain & NOISE):
        return 1, 0
    if (tag == "header" or plain & PAGE_HEAD) and not inside and not story:
        return 1, 0
    return 0, int(tag in ARTICLE or (story and tag in ("div", "section", "td")))


def blocks_of_page(page: str) -> tuple[list[int], list[str]]:
    """Kinds and texts of the page's blocks, in order."""
    kinds: list[int] = []
    texts: list[str] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []
    noise = article = at = 0

    def close() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                kinds.append(DROP if noise else KEEP if article else OPEN)
                texts.append(text)

    while True:
        tag = TAG.search(page, at)
        if tag is None:
            parts.append(page[at:])
            break
        if tag.start() > at:
            parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            close()
        if tag[1]:
            places = [k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name][:1]
            if places:
                close()
                for _, n, a in stack[places[0] :]:
                    noise, article = noise - n, article - a
                del stack[places[0] :]
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attributes = tag[3] or ""
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK and stack and stack[-1][0] == "p":
            _, n, a = stack.pop()
            noise, article = noise - n, article - a
        n, a = weight(name, attributes, article > 0)
        if n or a or name in ("div", "section", "ul", "ol", "table"):
            close()
            stack.append((name, n, a))
            noise, article = noise + n, article + a
    close()
    return kinds, texts


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def names_of_suffixes(page: int, host: str, kinds: list[int], texts: list[str], shortest: int) -> list[np.ndarray]:
    """Names of the first ``shortest`` tokens of every suffix of the page's open and dropped blocks, and of the doubled lengths.

    Equal names: equal tokens on the same host. A suffix that is shorter than a name has one that no other suffix has.
    """
    words = [w for k, t in zip(kinds, texts) if k != KEEP for w in t.split()]
    n = len(words) - shortest + 1
    if n < 1:
        return [np.zeros(0, dtype=np.int64)] * (1 + len(DOUBLED))
    values = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    one = np.full(n, xxhash.xxh64_intdigest(host), dtype=np.uint64)
    for k in range(shortest):
        one = one * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n]
    found, length = [one], shortest
    for _ in DOUBLED:
        half = found[-1]
        second = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(page & (2**64 - 1))
        second[: max(n - length, 0)] = half[length:]
        found.append((half ^ (half >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + second)
        length *= 2
    return [x.view(np.int64) for x in found]


def common_lengths(names: list[np.ndarray], pages: np.ndarray, shortest: int) -> np.ndarray:
    """Of sorted suffixes, the length up to which each equals a neighbour from another page; ``shortest`` at least."""
    longest = np.full(len(pages), shortest, dtype=np.int64)
    equal = np.ones(max(len(pages) - 1, 0), dtype=bool)
    for k, name in enumerate(names):
        equal &= name[1:] == name[:-1]
        starts = np.flatnonzero(np.append(True, ~equal))
        if k and len(pages):
            distinct = np.minimum.reduceat(pages, starts) != np.maximum.reduceat(pages, starts)
            sizes = np.diff(np.append(starts, len(pages)))
            longest[np.repeat(distinct, sizes)] = shortest * DOUBLED[k - 1]
    return longest


def unique_text(kinds: list[int], texts: list[str], repeats: list[tuple[int, int]], whole: set[int]) -> tuple[str, int]:
    """Open blocks without the tokens that a repeat (start, length) covers, and how many are; blocks in ``whole`` stay as they are."""
    n = sum(len(t.split()) for k, t in zip(kinds, texts) if k != KEEP)
    edge = np.zeros(n + 1, dtype=np.int64)
    for at, length in repeats:
        edge[at] += 1
        edge[min(at + length, n)] -= 1
    hidden = np.cumsum(edge)[:n] > 0
    at, kept = 0, []
    for block, (kind, text) in enumerate(zip(kinds, texts)):
        if kind == KEEP:
            kept.append(text)
            continue
        words = text.split()
        if block in whole:
            kept.append(text)
        elif kind == OPEN:
            left = [w for w, x in zip(words, hidden[at : at + len(words)]) if not x]
            if left:
                kept.append(" ".join(left))
        at += len(words)
    return "\n".join(kept), int(hidden.sum())


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = 8, copies: float = 0.1
) -> DataFrame:
    """Per page: id_col, url_col, text (blocks joined by line feeds), n_repeated (tokens that repeats cover) and open (left to repetition)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, page, url, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                kinds, texts = blocks_of_page(text.as_py() or "")
                undecided = KEEP not in kinds and OPEN in kinds
                if not undecided:  # the article is known: what is open stands outside it
                    kinds = [DROP if k == OPEN else k for k in kinds]
                rows.append((key, page, url, host_of(url), kinds, texts, undecided))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.string()), pa.bool_()]
            names = ["page", "page_id", "url", "host", "kinds", "blocks", "open"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                page, host, kinds, blocks = (c[k].as_py() for c in b.columns)
                found = names_of_suffixes(page, host, kinds, blocks, shortest)
                n = len(found[0])
                columns = [pa.array(np.full(n, page, dtype=np.int64)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, names=["page", "at", "name", *(f"name{k}" for k in DOUBLED)])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [b.column(k).to_numpy() for k in range(2, b.num_columns)]
            length = common_lengths(names, b.column(0).to_numpy(), shortest)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(length.astype(np.int32))], names=["page", "at", "length"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for kinds, blocks, repeats, whole in zip(*(c.to_pylist() for c in b.columns[2:])):
                found.append(unique_text(kinds, blocks, [(r["at"], r["length"]) for r in repeats or []], set(whole or [])))
            texts, repeated = zip(*found) if found else ((), ())
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_repeated"])

    small_batches(pages)
    key = F.xxhash64(pages[id_col], pages[url_col], pages[html_col])
    source = pages.select(key.alias("page"), pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    parsed = materialize(source.mapInArrow(parse, EXTRACTED), "blocks")
    kept = F.filter(F.zip_with("kinds", "blocks", lambda k, t: F.when(k == KEEP, t)), lambda t: t.isNotNull())
    known = parsed.where("not open").select("page_id", "url", F.array_join(kept, "\n").alias("text"), F.lit(0).cast("long").alias("n_repeated"), "open")

    # Names that distinct pages of a host share: of all pages, aggregated where they are made.
    every = parsed.select("page", "host", "kinds", "blocks").mapInArrow(suffixes, SUFFIX).select("page", "name")
    shared = every.groupBy("name").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a != b").select("name")
    mine = parsed.where("open").dropDuplicates(["page"]).select("page", "host", "kinds", "blocks").mapInArrow(suffixes, SUFFIX)
    array = join_unique(materialize(mine, "suffixes"), materialize(shared, "shared"), "name")
    order = ["name", *(f"name{k}" for k in DOUBLED), "page", "at"]
    array = array.select("page", "at", *order[:-2]).repartitionByRange(*order).sortWithinPartitions(*order)
    repeats = array.mapInArrow(neighbours, "page long, at int, length int").groupBy("page").agg(F.collect_list(F.struct("at", "length")).alias("repeats"))

    # An open block that few pages of the host hold word for word, and none outside its text, is a copied article.
    spread = parsed.select("page", "host", "kinds", "open", F.posexplode("blocks").alias("block", "said"))
    spread = spread.select("page", "host", "open", "block", F.get("kinds", F.col("block")).alias("kind"), F.xxhash64("said").alias("said"))
    held = spread.groupBy("host", "said").agg(F.countDistinct("page").alias("n"), F.max(F.col("kind") == DROP).alias("outside"), F.max("open").alias("open"))
    sizes = parsed.groupBy("host").agg(F.countDistinct("page").alias("pages"))
    few = held.where("n > 1 and open and not outside").join(sizes, "host").where(F.col("n") <= F.greatest(F.lit(2), F.col("pages") * copies))
    whole = spread.where(F.col("open") & (F.col("kind") == OPEN)).join(few.select("host", "said"), ["host", "said"])
    whole = whole.groupBy("page").agg(F.collect_set("block").alias("whole"))
    asked = parsed.where("open").join(repeats, "page", "left").join(whole, "page", "left")
    asked = asked.select("page_id", "url", "kinds", "blocks", "repeats", "whole")
    decided = asked.mapInArrow(finish, "page_id long, url string, text string, n_repeated long").withColumn("open", F.lit(True))
    return known.unionAll(decided).select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_repeated", "open")
