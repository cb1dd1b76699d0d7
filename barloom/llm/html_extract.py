"""Main text of web pages with site templates removed.

A page is read once into a tree of elements. Every block element, inside and outside of the article, is hashed with all that
it holds; Spark counts, per host, on how many different pages a hash is found (pages that show the same article count once).
Hashes found on many pages of a host are its template, and their subtrees are deleted. What markup already names as no
content (menus, footers, forms, adverts, comments, ...) goes in any case, as a small host has no repeats to count.
If a page then has an article, or else a main element, only the text inside remains. An article or main element itself and what
is around it are never template: copies of one article on many pages of a host are still articles. Which article a page shows is told by the
longest block of its content (no scripts, styles or dropped elements) that lies outside of recurring subtrees.

Blocks: character references are decoded, white space [\\x20\\x09-\\x0D] becomes one space, ends are trimmed, blocks that
are not empty are joined by one space.

Defined results: a null or empty html has an empty text. Broken markup is read leniently: unclosed elements end with
their parent, stray end tags and unfinished tags are ignored. Rows are independent, whatever their ids.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from barloom.llm.common import stored
from barloom.llm.url_rules import host_of

#: A subtree is template if it is on so many different pages of a host.
MIN_PAGES = 5
#: A page with a smaller share of text outside of recurring subtrees shows no article of its own.
LEAST_OWN = 0.1
#: Template hashes that are broadcast at most (8 bytes each); more are joined to the pages instead.
MAX_BROADCAST = 1_000_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S)
#: White space that is not one space already.
GAP = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HASHED = frozenset("address aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header menu nav ol p pre section table ul".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label legend map math menu nav noembed noframes noscript object optgroup option "
    "script select style svg template textarea title video".split())
#: Elements whose text is never part of a page's text, whatever its amount.
NO_TEXT = frozenset("datalist nav object optgroup option select svg".split())
#: Content if it stands inside of an article or main element.
KEPT_IN_ARTICLE = frozenset({"label", "math"})
#: A start tag ends open elements of these names, up to the nearest of the second set.
ENDS = {
    "p": (frozenset({"p"}), frozenset()), "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "option": (frozenset({"option"}), frozenset({"select"})),
}
_NAMES = (
    r"(?:ads?|advert[a-z]*|adsense|adbox|banner|promo|promotion|sponsor[a-z]*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|notice|cookies?|consent|"
    r"gdpr|popup|modal|newsletter|subscribe|subscription|comments?|disqus|replies|respond|related|recommended|share|sharing|social|widget|toolbar|pagination|pager|skip|login|signup)")
#: A whole class token or id that names no content: one of the names, or a compound of names and of words that only say where or what kind of box.
#: Compounds that say what a page has (has-sidebar, no-comments) or how it behaves (sticky-header) are names of wrappers.
NOT_CONTENT = re.compile(
    rf"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|google|gpt|dfp|js|block|post|article|entry|blog|sub|sign|\d+)[-_]+)*(?<!post-)(?<!article-)(?<!entry-)(?<!post_)(?<!article_)(?<!entry_)"
    rf"{_NAMES}(?:[-_]+(?:{_NAMES}|box|block|bar|area|section|list|links?|item|items|panel|slot|unit|container|wrapper|wrap|inner|content|body|buttons?|icons?|media|overlay|form|posts?|articles?|"
    rf"text|title|top|bottom|left|right|primary|secondary|main|\d+))*"
    rf"|(?:post|article|entry)[-_]+(?!header){_NAMES}(?:[-_]+(?:{_NAMES}|box|block|bar|area|section|list|links?|items?|container|wrapper|wrap|inner|buttons?|icons?|\d+))*", re.I)
#: Names of what readers or other pages say: its amount of text does not make it the page's content.
OF_OTHERS = re.compile(r"(?:^|[-_])(?:comments?|disqus|replies|respond|related|recommended)(?:$|[-_])", re.I)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


def dropped(name: str, rest: str, in_article: bool) -> str:
    """Why markup itself says that an element is no content: "tag", or "name" or "others" for a class or id; else empty."""
    if name in DROPPED and not (in_article and name in KEPT_IN_ARTICLE) or name == "header" and not in_article:
        return "tag"
    if not rest or name in ("html", "body", "main"):
        return ""
    why = ""
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return "tag"
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "tag"
        if key in ("class", "id"):
            for token in filter(NOT_CONTENT.fullmatch, html.unescape(value).split()):
                why = "others" if why == "others" or OF_OTHERS.search(token) else "name"
    return why


def chain(links: tuple) -> list[int]:
    """The numbers of a linked list (rest, number), outermost first."""
    out = []
    while links:
        links, number = links
        out.append(number)
    return out[::-1]


class Page:
    """Elements as parallel lists in page order, and pieces of text: (element, is_break, raw text)."""

    def __init__(self, source: str):
        self.names, self.parents, self.why, self.in_article = ["#page"], [-1], [""], [False]
        self.starts, self.ends = [0], [len(source)]
        self.pieces: list[tuple[int, str | None]] = []
        self.source = source
        self._read(source)
        spared = self._spared() if "name" in self.why or "others" in self.why else frozenset()
        self.drop = [False]
        for element in range(1, len(self.names)):
            self.drop.append(self.drop[self.parents[element]] or self.why[element] != "" and element not in spared)

    def _spared(self) -> set[int]:
        """Elements that a class or id names no content but that hold the page's only articles, or most of its text."""
        spared: set[int] = set()
        # named elements around each element, itself included; None below an element that goes by its tag
        named: list[tuple | None] = [()]
        text = [0] * len(self.names)
        hidden = [False]
        for element in range(1, len(self.names)):
            above, why = named[self.parents[element]], self.why[element]
            named.append(None if above is None or why == "tag" else (above, element) if why else above)
            hidden.append(hidden[self.parents[element]] or self.names[element] in RAW or self.names[element] in NO_TEXT)
        for kind in ("article", "main"):
            around = [chain(named[e]) for e, n in enumerate(self.names) if n == kind and named[e] is not None]
            if around:
                least = min(map(len, around))
                spared.update(e for c in around for e in c[:least])
                break
        for element, piece in self.pieces:
            if piece and not hidden[element]:
                text[element] += len(piece.strip())
        for element in range(len(text) - 1, 0, -1):
            text[self.parents[element]] += text[element]
        shown = [True]
        for element in range(1, len(text)):
            if self.why[element] == "name" and shown[self.parents[element]] and 2 * text[element] > text[0]:
                spared.add(element)
            shown.append(shown[self.parents[element]] and (not self.why[element] or element in spared))
        return spared

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        while True:
            m = MARKUP.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self.pieces.append((stack[-1], source[at:m.start()]))
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((stack[-1], m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
                continue
            rest = m["rest"] or m["rest2"] or ""
            if m["close"] or m["close2"]:
                self._close(stack, name, m.start(), m.end())
                continue
            self._implied(stack, name, m.start())
            parent = stack[-1]
            if name in BLOCKS:
                self.pieces.append((parent, None))
            if name in VOID:
                continue
            element = len(self.names)
            inside = self.in_article[parent] or name in ("article", "main")
            self.names.append(name)
            self.parents.append(parent)
            self.why.append(dropped(name, rest, inside))
            self.in_article.append(inside)
            self.starts.append(m.start())
            self.ends.append(len(source))
            if rest.endswith("/") and name not in BLOCKS and name not in RAW:
                self.ends[-1] = m.end()
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self.pieces.append((element, source[at:end.start() if end else len(source)]))
                at = self.ends[-1] = end.end() if end else len(source)
                continue
            stack.append(element)
        if at < len(source):
            self.pieces.append((stack[-1], source[at:]))

    def _close(self, stack: list[int], name: str, start: int, end: int) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if self.names[stack[depth]] == name:
                for element in stack[depth + 1:]:
                    self.ends[element] = start
                self.ends[stack[depth]] = end
                if name in BLOCKS:
                    self.pieces.append((stack[depth], None))
                del stack[depth:]
                return
            if self.names[stack[depth]] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                return

    def _implied(self, stack: list[int], name: str, start: int) -> None:
        closes, borders = ENDS["p"] if name in BLOCKS and name not in ENDS and name != "br" else ENDS.get(name, ((), ()))
        for depth in range(len(stack) - 1, 0, -1):
            open_name = self.names[stack[depth]]
            if open_name in closes:
                for element in stack[depth:]:
                    self.ends[element] = start
                del stack[depth:]
                return
            if open_name in borders or open_name in BLOCKS and open_name != "p" and name not in ("li", "dt", "dd", "tr", "td", "th", "option"):
                return

    @cached_property
    def hashes(self) -> list[tuple[int, int]]:
        """(element, hash) of the block elements that hold no article."""
        around = set()
        for element, name in enumerate(self.names):
            if name in ("article", "main") and not self.drop[element]:
                while element > 0:
                    around.add(element)
                    element = self.parents[element]
        return [(e, xxhash.xxh64_intdigest(GAP.sub(" ", self.source[self.starts[e]:self.ends[e]])) - (1 << 63))
                for e, name in enumerate(self.names) if name in HASHED and e not in around and not self.drop[e]]

    def own_blocks(self, recurring: set[int]) -> list[str]:
        """The blocks outside of ``recurring`` hashes; a page with little text besides is a copy of what recurs, and has all its blocks."""
        rest = self.blocks(recurring)
        if recurring:
            whole = self.blocks(set())
            if sum(map(len, rest)) < LEAST_OWN * sum(map(len, whole)):
                return whole
        return rest

    def signature(self, recurring: set[int]) -> int:
        """The longest block of the page's own text: pages with the same one show the same article."""
        return xxhash.xxh64_intdigest(max(self.own_blocks(recurring), key=len, default="")) - (1 << 63)

    def text(self, template: set[int]) -> str:
        return " ".join(self.own_blocks(template))

    def blocks(self, template: set[int]) -> list[str]:
        """The blocks of text that remain without the subtrees of ``template`` hashes."""
        gone = list(self.drop)
        if template:
            for element, value in self.hashes:
                if value in template:
                    gone[element] = True
        for element in range(1, len(gone)):
            gone[element] = gone[element] or gone[self.parents[element]]
        scope = next((kind for kind in ("article", "main") if any(n == kind and not g for n, g in zip(self.names, gone))), None)
        inside = [scope is None] * len(gone)
        for element in range(1, len(gone)):
            inside[element] = inside[self.parents[element]] or self.names[element] == scope
        blocks, run = [], []
        for element, piece in self.pieces:
            if piece is None:
                if run:
                    blocks.append("".join(run))
                    run = []
            elif inside[element] and not gone[element]:
                run.append(piece)
        blocks.append("".join(run))
        decoded = (GAP.sub(" ", html.unescape(b)).strip(" ") for b in blocks if b)
        return [b for b in decoded if b]


def site_hash(host: str, value: int) -> int:
    """One number for a hash on a host."""
    return xxhash.xxh64_intdigest(f"{host} {value}") - (1 << 63)


def with_known(rows: DataFrame, found: DataFrame, max_broadcast: int) -> tuple[DataFrame, Callable]:
    """``rows`` (host, html, ...) with ``own``, and the function (page, host, own) -> hashes of the page that are in ``found`` (site_hash).

    Few hashes are broadcast and ``own`` is null; more are joined to the pages.
    """
    if found.limit(max_broadcast + 1).count() <= max_broadcast:
        shared = rows.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in found.collect()), np.int64))

        def known(page: Page, host: str | None, own: list[int] | None) -> set[int]:
            every, values = shared.value, [v for _, v in page.hashes]
            sites = np.array([site_hash(host, v) for v in values], np.int64)
            at = np.searchsorted(every, sites)
            return {v for v, s, k in zip(values, sites, at) if k < len(every) and every[k] == s}

        return rows.withColumn("own", F.lit(None).cast("array<bigint>")), known

    def own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sites = [], []
            for host, source, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own = {site_hash(host, v) for _, v in Page(source.as_py() or "").hashes}
                keys += [key] * len(own)
                sites += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sites, pa.int64())], names=["row_key", "site_hash"])

    def known(page: Page, host: str | None, own: list[int] | None) -> set[int]:
        hits = set(own or ())
        return {v for _, v in page.hashes if site_hash(host, v) in hits} if hits else set()

    columns = rows.columns
    rows = rows.withColumn("row_key", F.xxhash64("host", "html"))
    pairs = rows.select("host", "html", "row_key").mapInArrow(own_hashes, "row_key long, site_hash long").join(found, "site_hash").groupBy("row_key").agg(F.collect_set("site_hash").alias("own"))
    return rows.join(pairs, "row_key", "left").select(*columns, "own"), known


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(site_hash) of the subtrees found on ``min_pages`` different pages of their host. ``pages``: host, html.

    Only what recurs on so many rows is looked at again, and there each signature counts once.
    """
    pages = pages.select("host", "html").where(F.col("html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                sites += {site_hash(host, value) for _, value in Page(source.as_py()).hashes}
            yield pa.RecordBatch.from_arrays([pa.array(sites, pa.int64())], names=["site_hash"])

    found = pages.mapInArrow(run, "site_hash long").groupBy("site_hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("site_hash")
    rows, known = with_known(pages, stored(found, "site-recurring"), max_broadcast)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, signatures = [], []
            for host, source, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                page = Page(source.as_py())
                recurring = known(page, host, own)
                if recurring:
                    sites += [site_hash(host, value) for value in recurring]
                    signatures += [page.signature(recurring)] * len(recurring)
            yield pa.RecordBatch.from_arrays([pa.array(sites, pa.int64()), pa.array(signatures, pa.int64())], names=["site_hash", "signature"])

    signed = rows.mapInArrow(sign, "site_hash long, signature long")
    return signed.groupBy("site_hash").agg(F.count_distinct("signature").alias("n")).where(F.col("n") >= min_pages).select("site_hash")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, text of every row."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    rows, known = with_known(rows, stored(templates(rows, min_pages, max_broadcast), "site-templates"), max_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, source, own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                page = Page(source.as_py() or "")
                texts.append(page.text(known(page, host, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType for f in pages.schema}
    out = StructType([StructField("page_id", kinds.get("page_id", LongType())), StructField("url", StringType()), StructField("text", StringType())])
    return rows.mapInArrow(run, out)
