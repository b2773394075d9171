"""More of the library's queries, registered beside the catalog's: text forms, addresses, pages, reports, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import language, schedule, urls
from loomset.operators import datasets, dedup, pages, text_items, timeseries
from loomset.plans.catalog import ORACLE_SQL, PIECES, SENT, STOP, W, daily, items, query, split_items, table


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _contains(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


# text

_SUFFIXES = "|".join(language.STEM_SUFFIXES)


@query(f"""SELECT doc_id, coalesce(array_to_string(list_transform({W}, lambda w: regexp_replace(w, '^(.{{3,}}?)(?:{_SUFFIXES})$', '\\1')), ' '), '') AS stems FROM documents""")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.stemmed(table(spark, sf_dir, "documents"), "doc_id", "text")


def _ends(suffixes: list[str]) -> str:
    return f"regexp_matches(w, '(?:{'|'.join(suffixes)})$')"


@query(f"""WITH t AS (SELECT doc_id, unnest({W}) AS w FROM documents)
SELECT doc_id, CASE WHEN {_ends(language.VERB_ENDS)} THEN 'VB' WHEN {_ends(language.ADVERB_ENDS)} THEN 'RB' WHEN {_ends(language.NOUN_ENDS)} THEN 'NN' WHEN {_ends(language.ADJECTIVE_ENDS)} THEN 'JJ'
WHEN w IN ({_in(language.DETERMINERS)}) THEN 'DT' WHEN w IN ({_in(language.PREPOSITIONS)}) THEN 'IN' WHEN w IN ({_in(language.CONJUNCTIONS)}) THEN 'CC' ELSE 'NN' END AS tag, count(*) AS n FROM t GROUP BY 1, 2""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.tag_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, len(w)::BIGINT AS words, len({PIECES.format(t="text")})::BIGINT AS strings, len({SENT})::BIGINT AS sentences, length(text)::BIGINT AS characters,
md5(coalesce(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|'), '')) AS bigrams_md5 FROM (SELECT doc_id, text, {W} AS w FROM documents)""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = text_items.tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return x.select("doc_id", "words", "strings", "sentences", "characters", F.md5(F.array_join("bigrams", "|")).alias("bigrams_md5"))


_SENT_WORDS = W.replace("text", "s")


@query(f"""WITH s AS (SELECT doc_id, unnest({SENT}) AS s, unnest(range(len({SENT}))) AS i FROM documents),
w AS (SELECT doc_id, unnest({W}) AS word, unnest(range(len({W}))) AS place FROM documents),
n AS (SELECT doc_id, word, count(*) AS n, min(place) AS place FROM w WHERE length(word) > 2 AND word NOT IN ({STOP}) GROUP BY 1, 2),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) <= 20),
t AS (SELECT doc_id, i, unnest({_SENT_WORDS}) AS word FROM s), c AS (SELECT t.doc_id, i, sum(n) AS score FROM t JOIN k ON t.doc_id = k.doc_id AND t.word = k.word GROUP BY 1, 2),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY coalesce(score, 0) * CASE WHEN s.i < 3 THEN 1.5::DOUBLE ELSE 1 END DESC, s.i DESC) AS rank FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND s.i = c.i),
b AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS summary FROM r WHERE rank <= 3 GROUP BY 1)
SELECT doc_id, CASE WHEN len({SENT}) <= 3 THEN text ELSE summary END AS summary FROM documents LEFT JOIN b USING (doc_id)""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.summarised(table(spark, sf_dir, "documents"), "doc_id", "text")


def _votes(half: str) -> str:
    return " + ".join(f"CASE WHEN sum(CASE WHEN ({half} >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << b} ELSE 0 END" for b in range(32))


@query(f"""WITH w AS (SELECT doc_id, md5(unnest({W})) AS m FROM documents), h AS (SELECT doc_id, ('0x' || substring(m, 17, 8))::BIGINT AS hi, ('0x' || substring(m, 25, 8))::BIGINT AS lo FROM w),
v AS (SELECT doc_id, {_votes("hi")} AS hi, {_votes("lo")} AS lo FROM h GROUP BY 1)
SELECT doc_id, lpad(lower(to_hex(coalesce(hi, 0)::BIGINT)), 8, '0') || lpad(lower(to_hex(coalesce(lo, 0)::BIGINT)), 8, '0') AS simhash FROM documents LEFT JOIN v USING (doc_id)""")
def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.simhash(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH w AS (SELECT item_id, unnest({W}) AS word FROM benchmark), t AS (SELECT item_id, word, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM t GROUP BY 1),
d AS (SELECT a.item_id, sum(a.n * b.n) AS dot FROM t a JOIN t b ON b.item_id = a.item_id + 1 AND a.word = b.word GROUP BY 1)
SELECT a.item_id, b.item_id AS other, round(coalesce(dot / (x.norm * y.norm), 0), 6) AS cosine FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 LEFT JOIN d ON d.item_id = a.item_id LEFT JOIN m x ON x.item_id = a.item_id LEFT JOIN m y ON y.item_id = b.item_id""")
def term_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", (F.col("item_id") + 1).alias("other")).join(b.select(F.col("item_id").alias("other")), "other", "left_semi").select("item_id", "other")
    terms = dedup.term_counts(b, "item_id", "text").withColumnRenamed("item_id", "id")
    return dedup.term_cosine(pairs, terms, "item_id", "other", "id")


@query(f"""SELECT doc_id, category FROM (SELECT doc_id, {"CASE " + " ".join(f"WHEN {_contains('lower(text)', t)} THEN '{k}'" for k, t in schedule.RESPONSE_WORDS.items())} END AS category FROM documents) WHERE category IS NOT NULL""")
def response_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", schedule.response_category(F.col("text")).alias("category")).filter("category is not null")


# pages and addresses

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_EXT = f"lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1))"
_URL_LABELS = "list_filter([" + ", ".join(f"CASE WHEN {_contains('lower(url)', t)} THEN '{k}' END" for k, t in urls.URL_WORDS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, {_EXT} AS extension,
CASE {" ".join(f"WHEN {_EXT} IN ({_in(v)}) THEN '{k}'" for k, v in urls.EXTENSIONS.items())} ELSE 'file' END AS media_kind, array_to_string({_URL_LABELS}, ',') AS labels,
regexp_matches(url, '/(en|de)/') AND NOT regexp_matches(url, 'utm_') AS wanted FROM pages""")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.extension(u).alias("extension"), urls.media_kind(urls.extension(u)).alias("media_kind"),
        F.array_join(urls.labels(u), ",").alias("labels"), urls.wanted(u, ["/(en|de)/"], ["utm_"]).alias("wanted"),
    )


def _page_text_sql() -> str:
    t = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in pages.BOILERPLATE:
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '{pages.BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, char in pages.ENTITIES.items():
        t = f"replace({t}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query(f"SELECT page_id, coalesce({_page_text_sql()}, '') AS text FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.page_text(F.col("html")).alias("text"))


@query("""WITH l AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a [^>]*href="([^"#]+)"', 1))) AS link FROM pages)
SELECT DISTINCT page_id, CASE WHEN starts_with(link, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)//', 1) || link WHEN starts_with(link, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || link ELSE link END AS link
FROM l WHERE lower(link) NOT LIKE 'javascript:%'""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


ROBOTS = "User-agent: *\nDisallow: /de/ # no German\nAllow: /en/1\nDisallow: /en/\nSitemap: /map.xml\nUser-agent: other\nDisallow: /\n"


@query(f"""SELECT page_id, CASE WHEN starts_with({_PATH}, '/de/') THEN false WHEN starts_with({_PATH}, '/en/1') THEN true WHEN starts_with({_PATH}, '/en/') THEN false ELSE true END AS allowed FROM pages""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    files = p.select(urls.host(F.col("url")).alias("host"), F.lit(ROBOTS).alias("text")).distinct()
    return pages.fetchable(p, "page_id", "url", pages.robots_rules(files, "host", "text"), "host", "loomset")


# reports and samples


@query("""WITH i AS (SELECT d.doc_id, lang, source, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels FROM documents d LEFT JOIN labels USING (doc_id)),
c AS (SELECT 'items' AS metric, 'all' AS name, count(*)::DOUBLE AS value FROM i UNION ALL SELECT 'items', 'labelled', count(*) FROM i WHERE len(labels) > 0 HAVING count(*) > 0
UNION ALL SELECT 'lang', coalesce(lang, 'none'), count(*) FROM i GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM i GROUP BY 2
UNION ALL SELECT 'label', label, count(*) FROM (SELECT unnest(labels) AS label FROM i) GROUP BY 2)
SELECT * FROM c UNION ALL SELECT 'imbalance', 'label', round(max(value) / min(value), 4) FROM c WHERE metric = 'label' HAVING count(*) > 0""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.statistics(items(spark, sf_dir), "labels", {"lang": "lang", "source": "source"})


@query("""WITH x AS (SELECT d.doc_id, CASE WHEN quality = 1 THEN 'quality' WHEN toxic = 1 THEN 'toxic' END AS label, md5('42:' || d.doc_id) AS h FROM documents d LEFT JOIN labels USING (doc_id)),
q AS (SELECT label, count(*) AS n, least(count(*), CASE WHEN label IS NULL THEN floor(100 * count(*) / (SELECT count(*) FROM x)) ELSE greatest(1, floor(100 * count(*) / (SELECT count(*) FROM x))) END) AS quota FROM x GROUP BY 1),
r AS (SELECT x.*, row_number() OVER (PARTITION BY x.label ORDER BY h, doc_id) <= quota AS chosen FROM x JOIN q ON x.label IS NOT DISTINCT FROM q.label),
m AS (SELECT doc_id, label, row_number() OVER (ORDER BY h, doc_id) AS k FROM r WHERE NOT chosen)
SELECT doc_id, coalesce(label, 'none') AS label FROM r WHERE chosen UNION ALL SELECT doc_id, coalesce(label, 'none') FROM m WHERE k <= 100 - (SELECT sum(quota) FROM q)""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.stratified_sample(items(spark, sf_dir), "doc_id", "labels", 100)


_RULES = {"type_known": "event_type IN ('click', 'view', 'purchase')", "value_in_range": "value BETWEEN 0 AND 100", "user_even": "user_id % 2 = 0"}


@query("WITH e AS (SELECT " + ", ".join(f"coalesce({sql}, false) AS {name}" for name, sql in _RULES.items()) + " FROM events) " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (NOT ({what})) AS broken, round(1 - count(*) FILTER (NOT ({what})) / count(*), 4) AS validity FROM e" for name, what in [*((n, n) for n in _RULES), ("all", " AND ".join(_RULES))]))
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.validation_report(table(spark, sf_dir, "events"), {name: F.expr(sql) for name, sql in _RULES.items()})


_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM orders" for c in _COLUMNS) + """), k AS (SELECT "column", count(*) AS n, count(value) AS filled, count(DISTINCT value) AS d, count(try_cast(value AS DOUBLE)) AS numbers,
count(*) FILTER (lower(trim(value)) IN ('true', 'false', 'yes', 'no', '0', '1', 't', 'f', 'y', 'n')) AS booleans, count(*) FILTER (regexp_matches(trim(value), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS dates FROM c GROUP BY 1)
SELECT "column", CASE WHEN filled = 0 THEN 'empty' WHEN regexp_matches("column", '(?i)(id|key)$') AND d > 0.99 * filled THEN 'id' WHEN booleans = filled THEN 'boolean' WHEN numbers > 0.9 * filled THEN 'numeric' WHEN dates > 0.8 * filled THEN 'datetime'
WHEN d <= 50 AND d * 20 <= filled THEN 'categorical' ELSE 'text' END AS kind, filled::BIGINT AS filled, d AS "distinct", round(1 - filled / n, 4) AS null_share FROM k""")
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.column_kinds(table(spark, sf_dir, "orders"), _COLUMNS)


# series and schedules


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_type, event_id, value FROM events JOIN q USING (event_type) WHERE value < a - (b - a) * 1.5::DOUBLE OR value > b + (b - a) * 1.5::DOUBLE""")
def iqr_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.iqr_anomalies(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 1.5)


@query(f"""WITH p AS ({ORACLE_SQL["decomposition"]}), v AS (SELECT event_type, var_pop(trend) AS t, var_pop(seasonal) AS s, var_pop(residual) AS r FROM p WHERE residual IS NOT NULL GROUP BY 1)
SELECT event_type, round(greatest(0.0::DOUBLE, 1 - r / (r + t)), 4) AS trend_strength, round(greatest(0.0::DOUBLE, 1 - r / (r + s)), 4) AS seasonal_strength FROM v""")
def seasonal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.seasonal_strength(daily(spark, sf_dir), "event_type", "day", "value")


@query("""WITH a AS (SELECT *, CASE WHEN coalesce(epoch(ts) - epoch(lag(ts) OVER w), 1e18) > 3600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, run::BIGINT AS run, min(ts) AS start, count(*) AS items, count(DISTINCT event_type) AS kinds FROM b GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT event_type) >= 2""")
def aligned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.aligned_groups(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", 3600)


@query("""WITH runs AS (SELECT r FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-12-31', INTERVAL 15 MINUTE) t(r) WHERE hour(r) BETWEEN 9 AND 17 AND isodow(r) <= 5)
SELECT event_id, minute(ts) % 15 = 0 AND hour(ts) BETWEEN 9 AND 17 AND isodow(ts) <= 5 AS due, r AS next_run FROM events ASOF JOIN runs ON ts < r""")
def schedule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cron = "*/15 9-17 * * 1-5"
    return table(spark, sf_dir, "events").select("event_id", schedule.cron_matches(F.col("ts"), cron).alias("due"), schedule.cron_next(F.col("ts"), cron, 10).alias("next_run"))


@query("""WITH s AS (SELECT doc_id, md5('42:' || doc_id) AS h FROM documents), p AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS k, count(*) OVER () AS n FROM s),
x AS (SELECT doc_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p)
SELECT split, lang, count(*) AS items, sum(length(text))::BIGINT AS characters FROM documents JOIN x USING (doc_id) GROUP BY CUBE (split, lang)""")
def version_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(spark, sf_dir).cube("split", "lang").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("characters"))
