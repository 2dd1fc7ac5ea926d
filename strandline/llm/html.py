"""Main text of web pages, with site templates removed.

Every page is read once into element subtrees, which are hashed. Spark counts
each hash over the pages of a host, and subtrees that recur on many of the
host's pages are deleted, on every page. What is left of the article, where a
page marks one, or of the page is the text.

Inside a marked article only boxes (div, section, lists of links and the like)
can be deleted for recurring: a sentence that many pages share is still the
article's. Marks settle what counts cannot see, as an advert that differs from
page to page: elements that are navigation, forms, comments and so on by their
tag, role or class. Class words that an article's own parts may bear as well
(AMBIGUOUS) count inside an article only if the subtree recurs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import written

#: A subtree is a template from so many pages and this share of a host's pages.
MIN_PAGES = 3
MIN_SHARE = 0.3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>?|[^<]++|<""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
# HTML's element kinds.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math object canvas video audio".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# What is not the article, by element, role and word of class or id.
_OUT_TAGS = set("nav footer aside form button select dialog menu head".split())
_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_OUT_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies respond discussion share sharing social related recommended popup modal overlay widget pagination pager toolbar".split())
_SITE_HEADER = {"header", "masthead", "topbar"}
AMBIGUOUS = set("share sharing social related recommended notice notices alert promotion promo banner overlay widget discussion".split())
#: Elements of a marked article that are subtrees of their own.
_BOXES = set("div section details center hgroup address search dl table ul ol".split())


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element's marks rule it out, and whether they only suggest it."""
    if tag in _OUT_TAGS or (tag == "header" and not in_article):
        return True, False
    doubt = False
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "role" and value in _OUT_ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("article", "main", "body", "html"):
            words = set(_WORD.findall(value))
            sure = words & (_OUT_WORDS - AMBIGUOUS if in_article else _OUT_WORDS | _SITE_HEADER)
            if sure:
                return True, False
            doubt |= bool(words & AMBIGUOUS)
    return False, doubt


class Page:
    """Subtrees and text blocks of a page, from one walk over its markup.

    ``nodes``: (hash, parent) of elements; ``kept``: (text, node) of the blocks of
    articles, or else of the main element, or else of the page. The node is the
    nearest element that can be deleted, or -1.
    """

    def __init__(self, html: str | None):
        self.nodes: list[list[int]] = []
        self.blocks: list[tuple[str, int]] = []
        self.articles: list[tuple[str, int]] = []
        self.mains: list[tuple[str, int]] = []
        self._stack: list[tuple] = []  # tag, node, unwanted, article, main, hash state, whether that is its own
        self._open: Counter[str] = Counter()
        self._text: list[str] = []
        self._walk(html or "")
        self._flush()
        while self._stack:
            self._pop()

    @property
    def kept(self) -> list[tuple[str, int]]:
        return self.articles or self.mains or self.blocks

    def _walk(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.match(html, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if not m[0].startswith(("<!", "<?")):
                    self._text.append(m[0])
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            elif tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            else:
                self._start(tag, m[3])

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag not in _INLINE:
            self._flush()
        if tag in _VOID:
            return
        if tag in _CLOSES_P and self._open["p"]:
            self._end("p")
        if tag in _SIBLINGS:
            own, limit = _SIBLINGS[tag]
            for depth in range(len(self._stack) - 1, -1, -1):
                name = self._stack[depth][0]
                if name in limit or name in _CLOSES_P - {"p"}:
                    break
                if name in own:
                    while len(self._stack) > depth:
                        self._pop()
                    break
        up = self._stack[-1] if self._stack else ("", -1, False, False, False, None, False)
        article = up[3] or tag == "article"
        out, doubt = _unwanted(tag, attributes, article)
        out = out or up[2]
        own = not (out or tag in ("html", "body", "main", "article")) and (not article or doubt or tag in _BOXES)
        node, state = up[1], None if out else up[5]
        if own:
            node, state = len(self.nodes), xxhash.xxh64(f"<{tag}{attributes.rstrip('/ ')}>")
            self.nodes.append([0, up[1]])
        self._stack.append((tag, node, out, article, up[4] or tag == "main", state, own))
        self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag not in _INLINE:
            self._flush()
        if self._open[tag]:
            while self._stack and self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, node, out, article, main, state, own = self._stack[-1]
        if tag not in _INLINE:
            self._flush()
        self._stack.pop()
        self._open[tag] -= 1
        if own:
            digest = state.intdigest() - (1 << 63)
            self.nodes[node][0] = digest
            if self._stack and self._stack[-1][5] is not None:
                self._stack[-1][5].update(digest.to_bytes(8, "little", signed=True))
        return tag

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(unescape("".join(self._text)).split())
        self._text.clear()
        if not text:
            return
        _, node, out, article, main, state, _ = self._stack[-1] if self._stack else ("", -1, False, False, False, None, False)
        if state is not None:
            state.update(b"<>" + text.encode("utf-8", "surrogatepass"))
        if out:
            return
        (self.articles if article else self.mains if main else self.blocks).append((text, node))


_SCHEMA = T.StructType([
    T.StructField("row", T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])),
    T.StructField("host", T.StringType()),
    T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.IntegerType())),
    T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("parents", T.ArrayType(T.IntegerType())),
])


def read_pages(pages: DataFrame) -> DataFrame:
    """row (page_id, url), host, the blocks of the page's main part (``texts``, and
    ``places``: the subtree of each) and its subtrees (``hashes``, ``parents``)."""
    row = T.StructType([pages.schema["page_id"], pages.schema["url"]])
    schema = T.StructType([T.StructField("row", row), *_SCHEMA.fields[1:]])
    arrow = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: tuple[list, ...] = ([], [], [], [])
                for html in part.column(2):
                    page = Page(html.as_py())
                    blocks = page.kept
                    for column, value in zip(out, ([t for t, _ in blocks], [p for _, p in blocks], [h for h, _ in page.nodes], [p for _, p in page.nodes]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(out, arrow, strict=True)]], schema.names)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.struct("page_id", "url").alias("row"), host.alias("host"), "html").mapInArrow(apply, schema)


def templates(read: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that recur on a host's pages. Both counts are
    summed before the shuffle, so a host with most of the pages is no burden."""
    pages = read.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = read.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    return seen.where(F.col("n") >= min_pages).join(pages, "host").where(F.col("n") >= min_share * F.col("pages")).select("host", "hash")


def _without(texts: list[str], places: list[int], hashes: list[int], parents: list[int], gone: set[int]) -> list[str]:
    dead: list[bool] = []
    for h, p in zip(hashes, parents, strict=True):
        dead.append(h in gone or (p >= 0 and dead[p]))
    return [t for t, p in zip(texts, places, strict=True) if p < 0 or not dead[p]]


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Null and empty html, and pages without text, give the empty text. A null url
    is a host of its own; null ids and repeated rows stay as they are; a host with
    most of the pages is counted by partial sums; very long pages are read whole;
    other columns are ignored; an empty table gives an empty result.
    """
    read = written(read_pages(pages), "html-pages")
    found = templates(read, min_pages, min_share)
    inside = F.exists("places", lambda p: p >= 0)
    rest = read.where(inside).withColumn("key", F.struct("row", F.xxhash64("texts", "hashes").alias("of")))
    hits = rest.select("key", "host", F.explode(F.array_distinct("hashes")).alias("hash")).join(found, ["host", "hash"])
    gone = hits.groupBy("key").agg(F.collect_set("hash").alias("gone")).withColumnRenamed("key", "gone key")
    none = F.array().cast("array<bigint>")
    left = rest.join(gone, F.col("key").eqNullSafe(F.col("gone key")), "left").select("row", "texts", "places", "hashes", "parents", F.coalesce("gone", none).alias("gone"))
    schema = T.StructType([read.schema["row"], T.StructField("text", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 6)]
            texts = ["\n".join(_without(*each[:4], set(each[4]))) for each in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    own = read.where(~inside).select("row", F.array_join("texts", "\n").alias("text"))
    both = own.union(left.mapInArrow(apply, schema))
    return both.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
