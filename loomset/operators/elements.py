"""Pages as a table of nodes, and what rests on it: main content, tables, item scopes, linked data and social cards.

nodes() reads each page once and gives a row for every element and every text: its place in the page, its parent,
depth and path (the places of all elements that it is in). All else are joins, groupings and windows over that
table; a page's texts are gathered per page only.

Broken nesting is mended by fixed rules: an element without content never has children; a new list entry, cell, row,
definition or option ends the one before it, and a block ends an open paragraph, each within the nearest list, table
or cell; an end tag closes the nearest open element of its name and all within, and is ignored if there is none.
What is open at the end of a page ends there. Elements nested more than MAX_DEPTH deep are put at that depth.

A null or empty page has no nodes. Rows with equal keys are kept apart by a row number, so repeated rows give
repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

from loomset.operators.shared import written

MAX_DEPTH = 256

# Elements without content, and what a new element ends, within which others.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CELL = {"table", "td", "th", "caption"}
ENDS = {
    **{tag: ({"p"}, _CELL | {"button", "object"}) for tag in _BLOCKS},
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}

# Fixed values of content scores: names that speak for and against an element, elements left out, blocks, and scores of elements.
UNLIKELY = "(?i)combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter|share|social|related|recommend|promo|banner|advertisement|nav|navigation|breadcrumb|cookie|modal|overlay"
POSITIVE = "(?i)article|body|content|entry|hentry|main|page|pagination|post|text|blog|story|prose"
HIDDEN = r"(?i)display:\s*none|visibility:\s*hidden"
REMOVED = ["script", "style", "noscript", "iframe", "form", "button", "input", "textarea", "select", "nav", "header", "footer", "aside", "figure", "figcaption"]
BLOCK_ELEMENTS = ["p", "div", "article", "section", "main", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "table", "tr", "td", "th"]
TAG_SCORES = {"article": 30, "main": 25, "section": 10, "div": 5}
#: White space as Python's str.strip() and str.split() have it.
_SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_REMOVED = frozenset(REMOVED)
_UNLIKELY, _POSITIVE, _HIDDEN = (re.compile(p, re.ASCII) for p in (UNLIKELY, POSITIVE, HIDDEN))


def _no_content(tag: str, attrs: dict) -> bool:
    """Whether an element holds no content: scripts, forms, navigation, hidden ones and those with unlikely names."""
    if tag in _REMOVED or not attrs:
        return tag in _REMOVED
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return bool(_HIDDEN.search(attrs.get("style", "")) or _UNLIKELY.search(names) and not _POSITIVE.search(names))


class _Reader(HTMLParser):
    """Nodes of one page in document order: (parent, depth, path, tag, attributes, text, gone)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple] = []
        self.open: list[tuple[str, int, bool]] = []

    def _add(self, tag: str, attrs: dict, text: str | None, bad: bool = False) -> int:
        path = [place for _, place, _ in self.open]
        self.nodes.append((path[-1] if path else -1, len(path), path, tag, attrs, text, bad or any(b for _, _, b in self.open)))
        return len(self.nodes) - 1

    def _end(self, names: set[str], within: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                del self.open[at:]
            elif self.open[at][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            self._end(*ENDS[tag])
        named = {k: v or "" for k, v in reversed(attrs)}
        bad = _no_content(tag, named)
        place = self._add(tag, named, None, bad)
        if tag not in VOID:
            del self.open[MAX_DEPTH - 1 :]
            self.open.append((tag, place, bad))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return
            if self.open[at][0] == "table":
                return

    def handle_data(self, data: str) -> None:
        self._add("", {}, data)


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """row (a number for each page), key, place, parent (-1: none), depth, path, tag (empty: a text), attrs, text and gone (within an element without content) of every node; written in the shared folder."""
    source = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html")).withColumn("row", F.monotonically_increasing_id())  # numbered once, as the nodes are written
    schema = StructType(
        [StructField("row", LongType()), StructField("key", source.schema["key"].dataType), StructField("place", IntegerType()), StructField("parent", IntegerType()), StructField("depth", IntegerType())]
        + [StructField("path", ArrayType(IntegerType())), StructField("tag", StringType()), StructField("attrs", MapType(StringType(), StringType())), StructField("text", StringType()), StructField("gone", BooleanType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, page in enumerate(b.column(2)):
                reader = _Reader()
                reader.feed(page.as_py() or "")
                reader.close()
                for at in range(0, len(reader.nodes), 10_000):
                    parent, depth, path, tag, attrs, text, gone = zip(*reader.nodes[at : at + 10_000], strict=True)
                    same = pa.array([i] * len(tag))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(same), b.column(1).take(same), pa.array(range(at, at + len(tag)), pa.int32()), pa.array(parent, pa.int32()), pa.array(depth, pa.int32()), pa.array(path, pa.list_(pa.int32()))]
                        + [pa.array(tag, pa.string()), pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string())), pa.array(text, pa.string()), pa.array(gone, pa.bool_())],
                        schema.names,
                    )

    return written(source.select("row", "key", "html").mapInArrow(read, schema))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _inner_text(found: DataFrame, of: DataFrame) -> DataFrame:
    """row, place and inner: the stripped texts within the elements `of` (row, place), in order, put together."""
    texts = found.filter("tag = ''").select("row", F.col("place").alias("at"), stripped(F.col("text")).alias("text"), F.explode("path").alias("place")).filter("text <> ''")
    return texts.join(of.select("row", "place"), ["row", "place"]).groupBy("row", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "").alias("inner"))


def main_content(pages: DataFrame, key: str, html: str, min_text: int = 25, min_content: int = 100, tags: Iterable[str] = tuple(TAG_SCORES)) -> DataFrame:
    """key, tag, score, text, n_words and excerpt of each page's element, of those named, that most looks like its content.

    An element's score grows with its text, its good paragraphs, its images, its kind and names, and falls with more
    than one link for a hundred characters. Without an element over 0 the body counts, without a body the page, and
    then the score is null. Pages without text have an empty one. Texts are shuffled once, to their page's task.
    """
    found = nodes(pages, key, html)
    names = F.concat_ws(" ", F.coalesce(F.col("attrs")["class"], F.lit("")), F.coalesce(F.col("attrs")["id"], F.lit("")))
    kept = found.filter("not gone")
    climbing = kept.filter("tag in ('', 'a', 'img')").select("row", F.col("place").alias("at"), "tag", F.length(stripped(F.coalesce("text", F.lit("")))).alias("n"), F.explode("path").alias("place"))
    measured = written(climbing.groupBy("row", "place").agg(F.sum("n").alias("length"), F.count(F.when(F.col("tag") == "a", 1)).alias("links"), F.count(F.when(F.col("tag") == "img", 1)).alias("images"), F.max("at").alias("last")))
    good = kept.filter("tag = 'p'").select("row", "place", "path").join(measured.filter(F.col("length") > min_text).select("row", "place"), ["row", "place"])
    good = good.select("row", F.explode("path").alias("place")).groupBy("row", "place").agg(F.count("*").alias("good"))

    of = kept.filter(F.col("tag").isin(*tags)).select("row", "place", "tag", names.alias("names")).join(measured.filter(F.col("length") >= min_content), ["row", "place"]).join(good, ["row", "place"], "left")
    density = F.col("links") / (F.col("length") / 100)
    kind = F.create_map(*(F.lit(x) for pair in TAG_SCORES.items() for x in pair))[F.col("tag")]
    score = F.least(F.col("length") / 100, F.lit(10.0)) + F.when(F.col("names").rlike(POSITIVE), 25).otherwise(0) - F.when(F.col("names").rlike(UNLIKELY), 25).otherwise(0) + kind
    score = score + F.coalesce("good", F.lit(0)) * 3 - F.when(density > 1, density * 5).otherwise(0.0) + F.least(F.col("images") * 2, F.lit(10))
    best = of.withColumn("score", score).filter("score > 0").groupBy("row").agg(F.max(F.struct("score", (-F.col("place")).alias("place"), "tag", "last")).alias("b")).select("row", (-F.col("b.place")).alias("place"), "b.tag", "b.score", "b.last")
    body = kept.filter("tag = 'body'").groupBy("row").agg(F.min("place").alias("body")).join(measured.select("row", F.col("place").alias("body"), F.col("last").alias("body_last")), ["row", "body"], "left")
    whole = found.select("row", "key").distinct().join(best, "row", "left").join(body, "row", "left")
    whole = whole.select("row", "key", F.coalesce("place", "body").alias("root"), F.when(F.col("place").isNotNull(), F.col("tag")).when(F.col("body").isNotNull(), "body").alias("tag"), "score", F.when(F.col("place").isNotNull(), F.col("last")).otherwise(F.col("body_last")).alias("last"))

    texts = kept.filter("tag = ''").select("row", "place", stripped(F.col("text")).alias("piece")).filter("piece <> ''")
    blocks = kept.filter(F.col("tag").isin(BLOCK_ELEMENTS)).select("row", "place").join(measured.filter("length > 0").select("row", "place"), ["row", "place"]).select("row", "place", F.lit("\n").alias("piece"))
    pieces = texts.unionByName(blocks).groupBy("row").agg(F.collect_list(F.struct("place", "piece")).alias("pieces"))
    inside = F.filter("pieces", lambda p: F.col("root").isNull() | (p["place"] > F.col("root")) & (p["place"] <= F.col("last")))  # an element's nodes follow it up to its last text
    text = F.array_join(F.transform(F.sort_array(inside), lambda p: p["piece"]), " ")
    tidy = stripped(F.regexp_replace(F.regexp_replace("text", rf"\n{_SPACE}*\n", "\n\n"), " +", " "))
    out = whole.join(pieces, "row", "left").select("key", "tag", "score", text.alias("text")).withColumn("text", F.coalesce(tidy, F.lit("")))
    return out.select(F.col("key").alias(key), "tag", F.round("score", 6).alias("score"), "text", F.regexp_count("text", F.lit(_SPACE.replace("[", "[^") + "+")).cast("long").alias("n_words"), excerpt(F.col("text")).alias("excerpt"))


def excerpt(text: Column, most: int = 300) -> Column:
    """The first paragraph, cut at its last full stop within `most` characters if that is past the half, else at a word."""
    first = F.substring_index(text, "\n\n", 1)
    head = F.substring(first, 1, most)
    dot = F.length(head) - F.length(F.substring_index(head, ".", -1))
    words = F.length(head) - F.length(F.substring_index(head, " ", -1))
    cut = F.when((dot > 0) & (dot - 1 > most * 0.5), F.substring(head, F.lit(1), dot)).otherwise(F.concat(F.when(words > 0, F.substring(head, F.lit(1), words - 1)).otherwise(head), F.lit("...")))
    return F.when(F.length(first) > most, cut).otherwise(first)


def page_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, author, published and language of each page that has nodes: of several sources the first that says anything, null without."""
    found = nodes(pages, key, html)
    a = F.col("attrs")
    meta = (F.col("tag") == "meta") & (stripped(a["content"]) != "")

    def named(*names: str) -> Column:
        return meta & (F.coalesce(a["name"].isin(*names), F.lit(False)) | F.coalesce(a["property"].isin(*names), F.lit(False)))

    classes = F.coalesce(a["class"], F.lit(""))
    rules = {
        "title": [(named("og:title"), False), (named("twitter:title"), False), (F.col("tag") == "h1", True), (F.col("tag") == "title", True)],
        "author": [(named("author"), False), (named("article:author"), False), (named("og:article:author"), False), (a["itemprop"] == "author", True), (a["rel"] == "author", True), (classes.rlike("(?i)author|byline"), True)],
        "published": [(named("article:published_time"), False), (named("og:article:published_time"), False), (named("date"), False), (named("pubdate"), False), (F.col("tag") == "time", True), (a["itemprop"] == "datePublished", True)],
        "language": [((F.col("tag") == "html") & (a["lang"] != ""), False), ((F.col("tag") == "meta") & (a["http-equiv"] == "Content-Language") & (a["content"] != ""), False)],
    }
    of = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(what).alias("what"), F.lit(rank).alias("rank"), F.lit(inner).alias("as_text"))) for what, each in rules.items() for rank, (when, inner) in enumerate(each))))
    picked = found.filter("tag <> ''").select("row", "place", "attrs", F.explode(of).alias("o")).select("row", "place", "attrs", "o.*")
    picked = picked.join(_inner_text(found, picked.filter("as_text").select("row", "place").distinct()), ["row", "place"], "left")
    value = F.when(F.col("what") == "language", F.coalesce(a["lang"], a["content"])).when(F.col("as_text") & (F.col("what") == "published"), F.coalesce(a["datetime"], a["content"], "inner")).when(F.col("as_text"), F.col("inner")).otherwise(stripped(a["content"]))
    first = picked.withColumn("value", value).filter("value <> ''").groupBy("row", "what").agg(F.min_by("value", F.struct("rank", "place")).alias("value"))
    rows = found.select("row", "key").distinct().join(first, "row", "left")
    return rows.groupBy("row", F.col("key").alias(key)).agg(*(F.max(F.when(F.col("what") == what, F.col("value"))).alias(what) for what in rules)).drop("row")


def page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table (from 1 in a page), title, row (from 1), column (from 1), header and value: each cell of each table that has a row of data.

    Headers are the cells of the first row of the table's head, else those of the first row of header cells only,
    which then is no data; a column beyond them is named column_N, N from 0, and without headers the name is null.
    Rows are those of the first body, or all of a table without one (its head's too). Nested tables' rows and cells
    count in the outer table too.
    """
    found = nodes(pages, key, html)
    n = found.filter("tag in ('table', 'caption', 'thead', 'tbody', 'tr', 'td', 'th')").select("row", "key", "place", "tag", "path")
    n = written(n.join(_inner_text(found, n.filter("tag in ('caption', 'td', 'th')")), ["row", "place"], "left").withColumn("inner", F.coalesce("inner", F.lit(""))))
    tables = n.filter("tag = 'table'").select("row", "key", F.col("place").alias("of"))
    within = n.select("row", "place", "tag", "path", "inner", F.explode("path").alias("of")).join(tables.select("row", "of"), ["row", "of"])
    parts = within.groupBy("row", "of").agg(F.min(F.when(F.col("tag") == "thead", F.col("place"))).alias("head"), F.min(F.when(F.col("tag") == "tbody", F.col("place"))).alias("body"), F.min_by("inner", F.when(F.col("tag") == "caption", F.col("place"))).alias("title"))
    lines = within.filter("tag = 'tr'").select("row", "of", F.col("place").alias("line"), "path").join(parts, ["row", "of"])
    cells = n.filter("tag in ('td', 'th')").select("row", "place", "tag", "inner", F.explode("path").alias("line"))
    filled = cells.join(lines.select("row", "line").distinct(), ["row", "line"]).groupBy("row", "line").agg(F.sort_array(F.collect_list(F.struct("place", "tag", "inner"))).alias("cells"))
    lines = written(lines.join(filled, ["row", "line"], "left").withColumn("cells", F.coalesce("cells", F.expr("array()"))).withColumn("texts", F.transform("cells", lambda c: c["inner"])))

    head = lines.filter(F.array_contains("path", F.col("head"))).groupBy("row", "of").agg(F.min_by("texts", "line").alias("headers")).filter(F.size("headers") > 0)
    data = lines.filter(F.coalesce(F.array_contains("path", F.col("body")), F.lit(True))).join(head, ["row", "of"], "left")
    all_th = (F.size("cells") > 0) & F.forall("cells", lambda c: c["tag"] == "th") & F.col("headers").isNull()
    named = data.filter(all_th).groupBy("row", "of").agg(F.min("line").alias("at"), F.min_by("texts", "line").alias("first"))
    data = data.join(named, ["row", "of"], "left").filter(F.col("at").isNull() | (F.col("line") != F.col("at"))).filter(F.size("texts") > 0).withColumn("headers", F.coalesce("headers", "first"))
    numbers = tables.join(data.select("row", "of").distinct(), ["row", "of"]).withColumn("table", F.row_number().over(Window.partitionBy("row").orderBy("of")))
    ranked = data.withColumn("k", F.row_number().over(Window.partitionBy("row", "of").orderBy("line"))).join(numbers, ["row", "of"])
    each = ranked.select("row", "key", "table", F.coalesce("title", F.lit("")).alias("title"), "k", "headers", F.posexplode("texts").alias("column", "value"))
    header = F.when(F.col("column") < F.size("headers"), F.try_element_at("headers", F.col("column") + 1)).when(F.col("headers").isNotNull(), F.concat(F.lit("column_"), F.col("column")))
    return each.select(F.col("key").alias(key), "table", "title", F.col("k").alias("row"), (F.col("column") + 1).alias("column"), header.alias("header"), "value")


def page_items(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, item (from 1 in a page), type, property, nth (from 1) and value: the properties within each item scope, those of scopes nested in it too."""
    found = nodes(pages, key, html)
    a = F.col("attrs")
    marked = written(found.filter(F.map_contains_key("attrs", "itemscope") | F.map_contains_key("attrs", "itemprop")))
    scopes = marked.filter(F.map_contains_key("attrs", "itemscope")).select("row", "key", F.col("place").alias("scope"), F.coalesce(a["itemtype"], F.lit("")).alias("type"))
    props = marked.filter(F.map_contains_key("attrs", "itemprop"))
    props = props.join(_inner_text(found, props), ["row", "place"], "left")
    value = F.when(F.col("tag") == "meta", a["content"]).when(F.col("tag") == "link", a["href"]).when(F.col("tag") == "img", a["src"])
    value = value.when((F.col("tag") == "time") & (a["datetime"] != ""), a["datetime"]).otherwise(F.col("inner"))
    each = props.select("row", "place", a["itemprop"].alias("property"), value.alias("value"), F.explode("path").alias("scope")).filter("property <> '' and value <> ''").join(scopes, ["row", "scope"])
    numbers = each.select("row", "scope").distinct().withColumn("item", F.row_number().over(Window.partitionBy("row").orderBy("scope")))
    nth = F.row_number().over(Window.partitionBy("row", "scope", "property").orderBy("place"))
    return each.withColumn("nth", nth).join(numbers, ["row", "scope"]).select(F.col("key").alias(key), "item", "type", "property", "nth", "value")


def json_ld(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place (of the script), n (from 1) and data (a variant) of each object of linked data; lists give their entries, broken ones nothing."""
    found = nodes(pages, key, html)
    scripts = found.filter((F.col("tag") == "script") & (F.col("attrs")["type"] == "application/ld+json")).select("row", "place")
    texts = found.filter("tag = ''").select("row", "key", F.col("parent").alias("place"), F.col("place").alias("at"), "text").join(scripts, ["row", "place"])
    whole = texts.groupBy("row", "key", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "").alias("text"))
    v = whole.select("row", "key", "place", F.try_parse_json("text").alias("v")).filter("v is not null")
    entries = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return v.select(F.col("key").alias(key), "place", F.posexplode(entries).alias("n", "data")).withColumn("n", F.col("n") + 1)


def social_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, kind (og or twitter), name and value of each card entry, the last of repeated ones."""
    found = nodes(pages, key, html)
    a = F.col("attrs")
    kinds = F.array_compact(F.array(*(F.when((F.col("tag") == "meta") & a[attr].startswith(f"{kind}:") & (a["content"] != ""), F.struct(F.lit(kind).alias("kind"), F.replace(a[attr], F.lit(f"{kind}:"), F.lit("")).alias("name"))) for kind, attr in (("og", "property"), ("twitter", "name")))))
    each = found.select("row", "key", "place", a["content"].alias("value"), F.explode(kinds).alias("k")).filter("k.name <> ''")
    return each.groupBy("row", "key", "k.kind", "k.name").agg(F.max_by("value", "place").alias("value")).select(F.col("key").alias(key), "kind", "name", "value")
