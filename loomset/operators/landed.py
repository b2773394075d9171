"""Records out of landed files: feeds, site maps, and labels and values in JSON metadata. Null contents give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.pages import ENTITIES

# Metadata fields that hold labels.
LABEL_FIELDS = ["labels", "tags", "categories", "keywords", "topics", "genre", "type"]
SINGLE_FIELDS = ["primary_category", "content_type"]


def element(xml: Column, name: str) -> Column:
    """The text of the first such element: a CDATA section as it is, else without tags and with references resolved; null if there is none."""
    raw = F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    inner = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    plain = F.regexp_replace(raw, r"<[^>]*>", "")
    for ref, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(ref), F.lit(char))
    return F.when(xml.rlike(rf"<{name}[\s>]"), F.trim(F.when(inner != "", inner).otherwise(plain)))


def _records(files: DataFrame, key: str, xml: str, name: str) -> DataFrame:
    return files.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(rf"(?s)<{name}[\s>].*?</{name}\s*>"), F.lit(0))).alias("place", "x"))


def rss_items(files: DataFrame, key: str, xml: str) -> DataFrame:
    """key, place, title, link, description, published of every item of RSS files."""
    x = F.col("x")
    return _records(files, key, xml, "item").select(key, "place", element(x, "title").alias("title"), element(x, "link").alias("link"), element(x, "description").alias("description"), element(x, "pubDate").alias("published"))


def atom_entries(files: DataFrame, key: str, xml: str) -> DataFrame:
    """key, place, title, link (the href), description, published of every entry of Atom files."""
    x = F.col("x")
    link = F.regexp_extract(x, r"""<link\s[^>]*?href=["']([^"']*)""", 1)
    return _records(files, key, xml, "entry").select(key, "place", element(x, "title").alias("title"), F.nullif(link, F.lit("")).alias("link"), F.coalesce(element(x, "summary"), element(x, "content")).alias("description"), F.coalesce(element(x, "published"), element(x, "updated")).alias("published"))


# The references that XML names itself.
NAMED = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'"}
_TOKEN = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<[^<>]*>|&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|lt|gt|amp|quot|apos);|[^<&]+|[<&]"


def content(xml: Column) -> Column:
    """The text of a piece of XML, read once from left to right and trimmed: CDATA as it is, tags and comments gone, references resolved, those to no character kept."""

    def one(t: Column) -> Column:
        n = F.length(t)
        code = F.when(F.lower(F.substring(t, 1, 3)) == "&#x", F.conv(F.substr(t, F.lit(4), n - 4), 16, 10)).otherwise(F.substr(t, F.lit(3), n - 3)).try_cast("long")
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        named = F.try_element_at(F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair)), t)
        plain = F.when(t.startswith("&#") & sound, letter).otherwise(F.coalesce(named, t))
        return F.when(t.startswith("<![CDATA[") & (n > 1), F.substr(t, F.lit(10), n - 12)).when(t.startswith("<") & (n > 1), "").otherwise(plain)

    return F.trim(F.array_join(F.transform(F.regexp_extract_all(xml, F.lit(_TOKEN), F.lit(0)), one), ""))


def inside(xml: Column, name: str) -> Column:
    """What stands in the first such element; null without one, empty if it closes itself."""
    found = F.get(F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?:\s[^>]*)?(?<!/)>(.*?)</{name}\s*>"), F.lit(1)), F.lit(0))
    return F.coalesce(found, F.when(xml.rlike(rf"<{name}[\s/>]"), ""))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; null without one."""
    quoted = F.regexp_extract(tag, rf"""(?s)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.when(quoted != "", content(F.substr(quoted, F.lit(2), F.length(quoted) - 2)))


def _tags(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?:\s[^>]*)?>"), F.lit(0))


def feed_records(files: DataFrame, key: str, xml: str) -> DataFrame:
    """key, kind (rss or atom), feed_title, place, title, link, record_id, author, categories, published, updated, content, media_url, media_type of every item or entry.

    A file with a feed element is Atom, any other RSS. An entry's link is its first that names alternate, else its first;
    its content is that or the summary. Texts that are missing are null, categories an empty array. A CDATA section that
    holds the end of its own element ends there. Files without records, empty ones and null give no rows.
    """
    x, whole = F.col("x"), F.col(xml)
    atom = whole.rlike(r"<feed[\s>]")
    record = F.when(atom, r"(?s)<entry[\s>].*?</entry\s*>").otherwise(r"(?s)<item[\s>].*?</item\s*>")
    rows = files.select(F.col(key), F.when(atom, "atom").otherwise("rss").alias("kind"), content(inside(F.regexp_replace(whole, record, F.lit("")), "title")).alias("feed_title"), F.posexplode(F.regexp_extract_all(whole, record, F.lit(0))).alias("place", "x"))
    is_atom = F.col("kind") == "atom"
    text = lambda name: content(inside(x, name))
    links = _tags(x, "link")
    link = F.coalesce(F.get(F.filter(links, lambda t: attribute(t, "rel") == "alternate"), F.lit(0)), F.get(links, F.lit(0)))
    media = F.get(_tags(x, "enclosure"), F.lit(0))
    names = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<category(?:\s[^>]*)?(?<!/)>(.*?)</category\s*>"), F.lit(1)), content)
    terms = F.transform(_tags(x, "category"), lambda t: F.coalesce(attribute(t, "term"), F.lit("")))
    return rows.select(
        key, "kind", "feed_title", "place", text("title").alias("title"), F.when(is_atom, attribute(link, "href")).otherwise(text("link")).alias("link"),
        F.when(is_atom, text("id")).otherwise(text("guid")).alias("record_id"), F.when(is_atom, content(inside(inside(x, "author"), "name"))).otherwise(F.coalesce(text("author"), text("dc:creator"))).alias("author"),
        F.when(is_atom, terms).otherwise(names).alias("categories"), F.when(is_atom, text("published")).otherwise(text("pubDate")).alias("published"), F.when(is_atom, text("updated")).alias("updated"),
        F.when(is_atom, F.coalesce(text("content"), text("summary"))).otherwise(text("description")).alias("content"), F.when(~is_atom, attribute(media, "url")).alias("media_url"), F.when(~is_atom, attribute(media, "type")).alias("media_type"),
    )


def sitemap_urls(files: DataFrame, key: str, xml: str) -> DataFrame:
    """key, place, url, modified of every address of site maps."""
    x = F.col("x")
    return _records(files, key, xml, "url").select(key, "place", element(x, "loc").alias("url"), element(x, "lastmod").alias("modified"))


def metadata_labels(metadata: Column) -> Column:
    """Distinct labels in a JSON object's label fields, each a list or a string of names between commas; sorted."""

    def of(field: str) -> Column:
        raw = F.get_json_object(metadata, f"$.{field}")
        return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.transform(F.split(raw, ","), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))

    single = F.array(*(F.get_json_object(metadata, f"$.{f}") for f in SINGLE_FIELDS))
    found = F.filter(F.concat(*(of(f) for f in LABEL_FIELDS), single), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def transformed(value: Column, transform: str) -> Column:
    """A value after `trim`, `lowercase`, `uppercase`, `regex:pattern` (its first group, the value if it isn't found) or `replace:a->b`."""
    if transform in ("trim", "lowercase", "uppercase"):
        return {"trim": F.trim, "lowercase": F.lower, "uppercase": F.upper}[transform](value)
    kind, _, rest = transform.partition(":")
    if kind == "regex":
        return F.when(value.rlike(rest), F.regexp_extract(value, rest, 1)).otherwise(value)
    if kind == "replace" and rest.count("->") == 1:
        return F.replace(value, *(F.lit(x) for x in rest.split("->")))
    return value
