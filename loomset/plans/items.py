"""Queries of language rules, landed records, labels, groups and graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import language, unicode
from loomset.operators import augmentation, curation, graph, landed, text_items, timeseries
from loomset.plans.catalog import EDGES, ORACLE_SQL, PIECES, SPLIT, W, daily, edges, items, query, split_items, table
from loomset.sources import exports

_FORMS = "map {" + ", ".join(f"'{f}': '{k}'" for f, k in language.IRREGULAR.items()) + "}"
_LEMMA = f"""coalesce({_FORMS}[w], CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y' WHEN ends_with(w, 'es') AND length(w) > 3 AND w[-3] IN ('s', 'x', 'z', 'h') THEN w[:-3]
WHEN ends_with(w, 's') AND length(w) > 2 AND w[-2] NOT IN ('s', 'u') THEN w[:-2] WHEN ends_with(w, 'ed') AND length(w) > 3 THEN CASE WHEN w[-3] = w[-4] THEN w[:-4] ELSE w[:-3] END
WHEN ends_with(w, 'ing') AND length(w) > 4 THEN CASE WHEN w[-4] = w[-5] THEN w[:-5] ELSE w[:-4] END ELSE w END)"""


@query(f"SELECT doc_id, array_to_string(list_transform({W}, lambda w: {_LEMMA}), ' ') AS lemmas FROM documents WHERE text IS NOT NULL")
def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", language.lemmas(F.col("text")).alias("lemmas"))


def _ends(suffixes: list[str]) -> str:
    return f"regexp_matches(w, '(?:{'|'.join(suffixes)})$')"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_TAG = f"""CASE WHEN {_ends(language.VERB_ENDS)} THEN 'VB' WHEN {_ends(language.ADVERB_ENDS)} THEN 'RB' WHEN {_ends(language.NOUN_ENDS)} THEN 'NN' WHEN {_ends(language.ADJECTIVE_ENDS)} THEN 'JJ'
WHEN w IN ({_in(language.DETERMINERS)}) THEN 'DT' WHEN w IN ({_in(language.PREPOSITIONS)}) THEN 'IN' WHEN w IN ({_in(language.CONJUNCTIONS)}) THEN 'CC' ELSE 'NN' END"""


@query("SELECT doc_id, " + ", ".join(f"array_to_string(list_filter({W}, lambda w: {_TAG} = '{k}'), ' ') AS {name}" for name, k in (("nouns", "NN"), ("verbs", "VB"), ("adjectives", "JJ"))) + " FROM documents WHERE text IS NOT NULL")
def words_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", *(F.array_join(language.of_kind(t, k), " ").alias(name) for name, k in (("nouns", "NN"), ("verbs", "VB"), ("adjectives", "JJ"))))


_VOTES = ", ".join(f"(-len(list_filter({W}, lambda w: w IN ({_in(v.split())}))), '{k}')" for k, v in language.COMMON_WORDS.items())


@query(f"""WITH b AS (SELECT doc_id, text, list_min([{_VOTES}]) AS b FROM documents) SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text)) < 20 OR b[1] = 0 THEN 'unknown' ELSE b[2] END AS detected FROM b""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", language.detected(F.col("text")).alias("detected"))


@query()
def cleaned_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    x = table(spark, sf_dir, "documents").select("doc_id", unicode.clean_text(t, urls=True, emails=True, mentions=True, hashtags=True, emojis=True, lower=True).alias("cleaned"), unicode.processed_text(t).alias("processed"))
    return x.select("doc_id", F.md5("cleaned").alias("cleaned"), F.length("cleaned").alias("n_cleaned"), F.md5("processed").alias("processed"), F.length("processed").alias("n_processed"))


@query("SELECT doc_id, upper(lang) AS upper, lower(source) AS lower, trim(text) AS trimmed, CASE WHEN regexp_matches(text, '([0-9]+)') THEN regexp_extract(text, '([0-9]+)', 1) ELSE text END AS number, replace(text, 'the', 'THE') AS replaced FROM documents")
def transformed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", landed.transformed(F.col("lang"), "uppercase").alias("upper"), landed.transformed(F.col("source"), "lowercase").alias("lower"), landed.transformed(t, "trim").alias("trimmed"),
        landed.transformed(t, "regex:([0-9]+)").alias("number"), landed.transformed(t, "replace:the->THE").alias("replaced"),
    )


@query(f"""WITH q AS ({ORACLE_SQL["quality_check"]}), n AS (SELECT reason, count(*) AS n FROM q GROUP BY 1) SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM n""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text_items.quality_check(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("reason").agg(F.count("*").alias("n"))
    return curation.with_share(n, "n")


# landed records and labels

_FEED = """f AS (SELECT item_id, item_id // 10 AS feed, item_id % 10 AS place, trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)"""


def feed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as parts of feeds of ten items."""
    b = table(spark, sf_dir, "benchmark").filter("item_id is not null and text is not null")
    return b.select("item_id", F.floor(F.col("item_id") / 10).alias("feed"), F.trim(F.regexp_replace("text", "[^A-Za-z ]", "")).alias("t"))


def _file(parts: DataFrame, head: str, one, tail: str) -> DataFrame:
    rows = parts.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("item_id", one.alias("x")))).alias("all"))
    return rows.select("feed", F.concat(F.lit(head), F.array_join(F.transform("all", lambda s: s["x"]), "\n"), F.lit(tail)).alias("xml"))


@query(f"WITH {_FEED} SELECT feed, (row_number() OVER (PARTITION BY feed ORDER BY item_id) - 1)::INT AS place, 'A & ' || substring(t, 1, 20) AS title, 'http://x.example/' || item_id AS link, t AS description, '2024-01-02' AS published FROM f")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("<item><title>A &amp; "), F.substring("t", 1, 20), F.lit("x</title><link>http://x.example/"), F.col("item_id"), F.lit("</link><description><![CDATA["), F.col("t"), F.lit("]]></description><pubDate>2024-01-02</pubDate></item>"))
    got = landed.rss_items(_file(feed_parts(spark, sf_dir), "<rss><channel><title>all</title>", one, "</channel></rss>"), "feed", "xml")
    return got.withColumn("title", F.expr("substring(title, 1, length(title) - 1)"))


@query(f"WITH {_FEED} SELECT feed, (row_number() OVER (PARTITION BY feed ORDER BY item_id) - 1)::INT AS place, 'no ' || item_id AS title, 'http://x.example/?a=' || item_id AS link, t AS description, '2024-01-03' AS published FROM f")
def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit('<entry><title type="text">no '), F.col("item_id"), F.lit('</title><link rel="self" href="http://x.example/?a='), F.col("item_id"), F.lit('"/><summary><b>'), F.col("t"), F.lit("</b></summary><updated>2024-01-03</updated></entry>"))
    return landed.atom_entries(_file(feed_parts(spark, sf_dir), "<feed>", one, "</feed>"), "feed", "xml")


@query(f"""WITH {_FEED}, k AS (SELECT *, feed % 2 = 1 AS atom, (row_number() OVER (PARTITION BY feed ORDER BY item_id) - 1)::INT AS at_place FROM f)
SELECT feed, CASE WHEN atom THEN 'atom' ELSE 'rss' END AS kind, 'all & ' || feed AS feed_title, at_place AS place, 'é < ' || item_id AS title, 'http://x.example/?a=' || item_id || '&b' AS link, 'id:' || item_id AS record_id, 'N. ' || substring(t, 1, 1) || '.' AS author,
'a & b|' || item_id AS categories, '2024-01-02' AS published, CASE WHEN atom THEN '2024-01-03' END AS updated, trim(t || ' <&amp;> ok') AS content, CASE WHEN NOT atom THEN 'http://m.example/' || item_id || '?p&q' END AS media_url, CASE WHEN NOT atom THEN 'audio/mpeg' END AS media_type FROM k""")
def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("item_id").cast("string"), F.col("t")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    body = said("<![CDATA[", t, " <&amp;>]]> &#111;&#x6b;")
    initial = F.substring("t", 1, 1)
    rss = said("<item><title>&#233; &lt; ", n, "</title><link>http://x.example/?a=", n, "&amp;b</link><guid isPermaLink='false'>id:", n, "</guid><author>N. ", initial, ".</author><category>a &amp; b</category><category>", n, "</category><pubDate>2024-01-02</pubDate><description>", body, "</description><enclosure type='audio/mpeg' url='http://m.example/", n, "?p&amp;q'/></item>")
    atom = said("<entry><title type='html'>&#xe9; &lt; ", n, "</title><link rel='self' href='http://self.example/'/><link href=\"http://x.example/?a=", n, "&amp;b\" rel='alternate'/><id>id:", n, "</id><author><email>e</email><name>N. ", initial, ".</name></author><category term='a &amp; b'/><category term='", n, "'/><published>2024-01-02</published><updated>2024-01-03</updated><summary>no</summary><content>", body, "</content></entry>")
    parts = feed_parts(spark, sf_dir)
    files = []
    for odd, one, head, tail in ((0, rss, "<rss><channel><title>all &amp; ", "</channel></rss>"), (1, atom, "<feed><title>all &amp; ", "</feed>")):
        f = _file(parts.filter(F.col("feed") % 2 == odd), "", one, tail)
        files.append(f.select("feed", F.concat(F.lit(head), F.col("feed").cast("string"), F.lit("</title>"), F.col("xml")).alias("xml")))
    return landed.feed_records(files[0].unionByName(files[1]), "feed", "xml").withColumn("categories", F.array_join("categories", "|"))


@query("SELECT page_id // 100 AS feed, (row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1)::INT AS place, url, CASE WHEN page_id % 2 = 0 THEN '2024-05-01' END AS modified FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter("page_id is not null and url is not null").select(F.col("page_id").alias("item_id"), F.floor(F.col("page_id") / 100).alias("feed"), exports.escaped(F.col("url")).alias("t"))
    one = F.concat(F.lit("<url>\n <loc>"), F.col("t"), F.lit("</loc>"), F.when(F.col("item_id") % 2 == 0, "<lastmod>2024-05-01</lastmod>").otherwise(""), F.lit("</url>"))
    return landed.sitemap_urls(_file(p, "<urlset>", one, "</urlset>"), "feed", "xml")


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([lang, source, 'a b', 'c', 'text'], lambda x: x IS NOT NULL AND x <> ''))), '|') AS labels FROM documents""")
def metadata_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct(F.array("lang").alias("labels"), F.lit(" a b, c,,").alias("tags"), F.col("source").alias("genre"), F.lit("text").alias("content_type")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(landed.metadata_labels(meta), "|").alias("labels"))


# splits, groups and counters


@query(f"WITH {SPLIT} SELECT doc_id, CASE WHEN source = 'web' THEN 'test' ELSE split END AS split, 'unassigned' AS reset FROM split")
def assigned_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(spark, sf_dir).select("doc_id", F.when(F.col("source") == "web", "test").otherwise(F.col("split")).alias("split"), F.lit("unassigned").alias("reset"))


@query("SELECT conv_id, count(*) AS members, array_to_string(list_sort(list(DISTINCT role)), ',') AS kinds, count(DISTINCT role) > 1 AS aligned FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def member_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.member_groups(table(spark, sf_dir, "conversations").filter("conv_id is not null"), "conv_id", "role")


@query("SELECT role AS kind, count(*) AS items, count(conv_id) AS grouped, round(count(conv_id) / count(*), 6) AS coverage FROM conversations GROUP BY 1")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.group_coverage(table(spark, sf_dir, "conversations"), "conv_id", "role")


@query("SELECT o_orderpriority AS kind, o_orderstatus AS state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.state_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


# graph views


@query(f"WITH {EDGES} SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS neighbours FROM edges GROUP BY 1")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(edges(spark, sf_dir)).withColumn("neighbours", F.array_join("neighbours", ","))


@query(f"WITH {EDGES}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT id, count(*) AS degree FROM e GROUP BY 1) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 10")
def central_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(10).select("id", "degree")


@query("""SELECT k::INT AS step, id FROM (SELECT 0 AS k, 'c1' AS id UNION ALL SELECT 1, 'n' || c_nationkey FROM customer WHERE c_custkey = 1 UNION ALL SELECT 2, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1)""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    end = e.filter("src = 'c1'").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").agg(F.min("end")).first()[0]
    return graph.shortest_path(e, "c1", end)


# series, embeddings, augmentation

_ACF = "WITH x AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL)"


@query()
def detected_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.detected_period(daily(spark, sf_dir), "event_type", ["day"], "value", 20)


_WORDS = PIECES.format(t="text")


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w, unnest(range(len({_WORDS}))) AS i FROM documents), g AS (SELECT doc_id, i, w[j:j + 2] AS g FROM (SELECT doc_id, w, i, unnest(range(1, length(w) - 1)) AS j FROM w WHERE length(w) >= 3)),
v AS (SELECT doc_id, (('0x' || substring(md5(g), 1, 8))::BIGINT % 384)::INT AS dim, sum(1 / (1 + ln(1 + i))) AS v FROM g GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1)
SELECT doc_id, dim, round(v / n, 5) AS value FROM v JOIN n USING (doc_id)""")
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.hashed_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def words_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.synonyms(table(spark, sf_dir, "documents"), "doc_id", "text")


_CHANCE = "(('0x' || substring(md5('0:' || {key} || ':' || ({place})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_SPACED = PIECES.format(t="text").replace("lower(text)", "text")


@query(f"""WITH w AS (SELECT doc_id, {_SPACED} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT *, floor({_CHANCE.format(key='doc_id', place='-3')} * len(w))::INT + 1 AS i, floor({_CHANCE.format(key='doc_id', place='-4')} * (len(w) + 1))::INT AS j FROM w)
SELECT doc_id, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_concat(w[:j], [w[i]], w[j + 1:]), ' ') END AS text FROM p""")
def words_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.random_insertion(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")


@query()
def characters_mistyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.mistyped(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH RECURSIVE {EDGES}, n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
p AS (SELECT src AS s, [src, dst] AS way FROM edges WHERE src <> dst UNION ALL SELECT s, list_append(way, dst) FROM p JOIN edges ON way[-1] = src AND NOT list_contains(way, dst)),
best AS (SELECT *, count(*) OVER (PARTITION BY s, way[-1]) AS ways FROM (SELECT * FROM p QUALIFY len(way) = min(len(way)) OVER (PARTITION BY s, way[-1]))),
i AS (SELECT unnest(way[2:-2]) AS id, 1 / ways AS part FROM best WHERE len(way) > 2), t AS (SELECT id, sum(part) AS part FROM i GROUP BY 1)
SELECT n.id, round(coalesce(part, 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 6) AS betweenness FROM n LEFT JOIN t ON t.id = n.id""")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.betweenness(edges(spark, sf_dir))
