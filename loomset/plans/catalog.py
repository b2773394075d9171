"""Every query of the library's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import text as X
from loomset.functions import schedule, similarity
from loomset.operators import agreement, augmentation, curation, graph, points, profiling, splits, text_items, timeseries
from loomset.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, as the operators' item rows."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    names = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return d.join(lab, "doc_id", "left").withColumn("labels", names)


W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda s: s <> '')"
PIECES = "list_filter(regexp_split_to_array(lower({t}), '[ \\t\\n\\x0B\\f\\r]+'), lambda s: s <> '')"
SPLIT = """h AS (SELECT doc_id, source, md5('42:' || doc_id) AS h FROM documents),
p AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS k, count(*) OVER () AS n FROM h),
split AS (SELECT doc_id, source, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p)"""
STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
RATINGS = """ratings AS (
SELECT vec_id AS item, 'a' AS annotator, label FROM embeddings
UNION ALL SELECT vec_id, 'b', CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END FROM embeddings
UNION ALL SELECT vec_id, 'c', CASE WHEN vec_id % 3 = 0 THEN (label + 2) % 10 ELSE label END FROM embeddings)"""
EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
POINTS = "points AS (SELECT label AS cloud, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    made = {"a": F.col("label"), "b": F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), "c": F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 2) % 10).otherwise(F.col("label"))}
    return e.select(F.col("vec_id").alias("item"), F.explode(F.array(*(F.struct(F.lit(k).alias("annotator"), v.alias("label")) for k, v in made.items()))).alias("r")).select("item", "r.*")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(a: str, x: str, b: str, y: str, t: str) -> DataFrame:
        return table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))

    return profiling.union_all([named("c", "c_custkey", "n", "c_nationkey", "customer"), named("s", "s_suppkey", "n", "s_nationkey", "supplier"), named("n", "n_nationkey", "r", "n_regionkey", "nation")])


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cloud"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.join(splits.auto_split(d, "doc_id"), "doc_id")


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))


# text


@query(f"""SELECT doc_id, length(text)::BIGINT AS char_count, len(w)::BIGINT AS word_count, len(s)::BIGINT AS sentence_count,
round(list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1) + 1e-9, 2) AS avg_word_length,
round(len(w) / greatest(len(s), 1) + 1e-9, 2) AS avg_sentence_length, round(len(list_distinct(w)) / greatest(len(w), 1) + 1e-9, 3) AS unique_ratio
FROM (SELECT doc_id, text, {W} AS w, {SENT} AS s FROM documents)""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.text_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH x AS (SELECT doc_id, len({SENT}) AS s, len({W}) AS w,
list_sum(list_transform({W}, lambda v: greatest(1, len(regexp_extract_all(v, '[aeiouy]+')) - CASE WHEN v LIKE '%e' AND len(regexp_extract_all(v, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS y FROM documents),
z AS (SELECT doc_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (y / w))) AS e, greatest(0.0::DOUBLE, 0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (y / w) - 15.59::DOUBLE) AS g FROM x WHERE s > 0 AND w > 0)
SELECT doc_id, round(e, 2) AS ease, round(g, 1) AS grade, CASE WHEN e >= 90 THEN 'very_easy' WHEN e >= 80 THEN 'easy' WHEN e >= 70 THEN 'fairly_easy' WHEN e >= 60 THEN 'standard' WHEN e >= 50 THEN 'fairly_difficult' WHEN e >= 30 THEN 'difficult' ELSE 'very_difficult' END AS difficulty FROM z""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.readability(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, unnest({W}) AS w FROM documents), p AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
x AS (SELECT doc_id, sum(n) AS words, count(*) AS types, sum((n = 1)::INT) AS once, sum(length(w) * n) AS letters FROM p GROUP BY 1 HAVING sum(n) >= 10)
SELECT doc_id, round(types / words + 1e-9, 3) AS ttr, round(once / types + 1e-9, 3) AS hapax_ratio, round(letters / words + 1e-9, 2) AS avg_word_length,
round(0.4::DOUBLE * least(1.0::DOUBLE, types / words * 2) + 0.3::DOUBLE * (1 - once / types) + 0.3::DOUBLE * least(1.0::DOUBLE, letters / words / 6), 3) AS score FROM x""")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.coherence(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, unnest({W}) AS word, unnest(range(len({W}))) AS place FROM documents),
n AS (SELECT doc_id, word, count(*) AS n, min(place) AS place FROM w WHERE length(word) > 2 AND word NOT IN ({STOP}) GROUP BY 1, 2)
SELECT doc_id, rank::INT AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS rank FROM n) WHERE rank <= 10""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.keywords(table(spark, sf_dir, "documents"), "doc_id", "text")


_SPAM = " + ".join(f"regexp_matches(lower(t), '{p}')::INT" for p in X.SPAM_PATTERNS)


@query(f"""WITH a AS (SELECT doc_id, text, trim(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS t FROM documents),
b AS (SELECT *, {PIECES.format(t="t")} AS w, {_SPAM} AS spam, len(list_filter(regexp_split_to_array(t, '[.!?。！？]'), lambda s: regexp_replace(s, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') <> '')) AS parts,
len(regexp_extract_all(t, '[.,!?;:،؛]')) AS marks FROM a),
c AS (SELECT *, least(1.0::DOUBLE, least(length(t) / 500, 0.3::DOUBLE) + coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0) * 0.3::DOUBLE
+ CASE WHEN parts = 0 THEN 0 WHEN len(w) / parts BETWEEN 5 AND 30 THEN 0.2::DOUBLE WHEN len(w) / parts > 0 THEN 0.1::DOUBLE ELSE 0 END
+ CASE WHEN marks / greatest(len(w), 1) BETWEEN 0.05::DOUBLE AND 0.3::DOUBLE THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN spam = 0 THEN 0.1::DOUBLE ELSE 0 END) AS score FROM b),
d AS (SELECT *, CASE WHEN text = '' THEN 'empty_content' WHEN length(t) < 20 THEN 'too_short' WHEN len(w) < 3 THEN 'too_few_words'
WHEN regexp_matches(lower(t), '^[^\\p{{L}}\\p{{N}}_]*$') OR regexp_matches(lower(t), '^(lorem ipsum|test|asdf|qwerty)') THEN 'low_quality_pattern'
WHEN spam >= 2 THEN 'spam_detected' WHEN score < 0.3::DOUBLE THEN 'low_quality_score' ELSE 'passed' END AS reason FROM c)
SELECT doc_id, reason = 'passed' AS is_valid, reason, round(CASE WHEN reason = 'empty_content' THEN 0 WHEN reason IN ('too_short', 'too_few_words', 'spam_detected') THEN 0.1::DOUBLE WHEN reason = 'low_quality_pattern' THEN 0.2::DOUBLE ELSE score END, 6) AS score FROM d""")
def quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.quality_check(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH a AS (SELECT d.doc_id, text, length(text) AS n, {PIECES.format(t="text")} AS w, coalesce(quality = 1 OR toxic = 1, false) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)),
b AS (SELECT *, CASE WHEN n < 50 THEN 0.5::DOUBLE WHEN n < 100 THEN 0.7::DOUBLE ELSE 1::DOUBLE END
* CASE WHEN len(regexp_extract_all(text, '[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r\\x{{0600}}-\\x{{06FF}}]')) / greatest(n, 1) > 0.3::DOUBLE THEN 0.6::DOUBLE ELSE 1::DOUBLE END
* CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.3::DOUBLE THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS s FROM a)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0 WHEN labelled THEN least(s * 1.1::DOUBLE, 1) ELSE s END, 2) AS quality_score FROM b""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.quality_score(items(spark, sf_dir), "doc_id", "text", "labels")


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')))::BIGINT AS emails,
len(list_distinct(regexp_extract_all(text, 'https?://[^ \\t\\n\\r<>"]+')))::BIGINT AS urls,
len(list_distinct(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}')))::BIGINT AS dates,
len(list_distinct(regexp_extract_all(text, '[$€£][0-9,]+(?:\\.[0-9]{2})?')))::BIGINT AS money,
len(list_distinct(regexp_extract_all(text, '#[A-Za-z0-9_]+')))::BIGINT AS hashtags, len(list_distinct(regexp_extract_all(text, '@[A-Za-z0-9_]+')))::BIGINT AS mentions FROM documents""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.entities(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256,
md5(regexp_replace(regexp_replace(trim(lower(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[^\\p{L}\\p{N}_ ]', '', 'g')) AS normalized FROM documents""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.hashes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, array_to_string(list_filter({W}, lambda s: s NOT IN ({STOP})), ' ') AS text, len(list_filter({W}, lambda s: s IN ({STOP})))::BIGINT AS removed FROM documents""")
def stopwords_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.without_stopwords(table(spark, sf_dir, "documents"), "doc_id", "text")


_LABELS = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + f" THEN '{name}' END" for name, terms in X.LABEL_WORDS.items())


@query(f"""SELECT doc_id, array_to_string(l, ',') AS labels, round(least(len(l) * 0.2::DOUBLE, 1), 1) AS confidence FROM (SELECT doc_id, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS l FROM documents)""")
def auto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.labelled(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH a AS (SELECT doc_id, length(text)::BIGINT AS length_before, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'https?://[^ \\t\\n\\r]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '[@#][A-Za-z0-9_]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS text FROM documents)
SELECT doc_id, length_before, text, length(text)::BIGINT AS length_after FROM a""")
def text_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items.cleaned(table(spark, sf_dir, "documents"), "doc_id", "text")


# splits and leakage


@query(f"WITH {SPLIT} SELECT doc_id, split FROM split")
def auto_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.auto_split(table(spark, sf_dir, "documents"), "doc_id")


@query("""WITH h AS (SELECT doc_id, source, md5('42:' || doc_id) AS h FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM h)
SELECT doc_id, source, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(table(spark, sf_dir, "documents"), "doc_id", "source")


@query(f"""WITH {SPLIT} SELECT source, sum((split = 'train')::INT)::BIGINT AS train, sum((split = 'val')::INT)::BIGINT AS val, sum((split = 'test')::INT)::BIGINT AS test, count(*) AS total FROM split GROUP BY 1""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_stats(split_items(spark, sf_dir), "split", "source")


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM p""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_split(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


@query("""WITH d AS (SELECT ts::DATE AS day FROM events), s AS (SELECT min(day) AS low, max(day) AS high FROM d),
w AS (SELECT high, unnest(range(low, high + INTERVAL 1 DAY, INTERVAL 7 DAY))::DATE AS start FROM s)
SELECT start, sum((day < start + 14)::INT)::BIGINT AS train_rows, sum((day >= start + 14)::INT)::BIGINT AS test_rows FROM w JOIN d ON day >= start AND day < start + 21 WHERE start + 21 <= high + 1 GROUP BY 1""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sliding_windows(table(spark, sf_dir, "events"), "ts")


_HASH = "md5(regexp_replace(trim(lower(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"""WITH {SPLIT}, l AS (SELECT {_HASH} AS hash, split, max(doc_id) AS id FROM documents JOIN split USING (doc_id) GROUP BY 1, 2)
SELECT a.hash, a.split AS split1, a.id AS id1, b.split AS split2, b.id AS id2 FROM l a JOIN l b USING (hash) WHERE (a.split = 'train' AND b.split <> 'train') OR (a.split = 'val' AND b.split = 'test')""")
def exact_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.exact_leakage(split_items(spark, sf_dir), "doc_id", "text", "split")


@query(f"""WITH {SPLIT}, n AS (SELECT source, split, count(*) AS n FROM split GROUP BY ALL)
SELECT t.source, t.n AS train_rows, o.split AS other, o.n AS other_rows, CASE WHEN t.n >= 10 THEN 'high' ELSE 'medium' END AS severity FROM n t JOIN n o USING (source) WHERE t.split = 'train' AND o.split <> 'train'""")
def source_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.source_leakage(split_items(spark, sf_dir), "source", "split")


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM events),
l AS (SELECT split AS other, min(ts) AS low FROM e WHERE split <> 'train' GROUP BY 1)
SELECT other, count(*) AS overlap, CASE WHEN count(*) > 100 THEN 'high' ELSE 'medium' END AS severity FROM e JOIN l ON ts > low WHERE split = 'train' GROUP BY 1""")
def temporal_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 10
    e = table(spark, sf_dir, "events").withColumn("split", F.when(k < 8, "train").when(k == 8, "val").otherwise("test"))
    return splits.temporal_leakage(e, "ts", "split")


@query("""SELECT doc_id, uncertainty FROM (SELECT doc_id, 1 - coalesce(CASE WHEN quality <> 0 THEN quality::DOUBLE END, 0.5::DOUBLE) AS uncertainty FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY uncertainty DESC, doc_id LIMIT 50""")
def active_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.active_learning(items(spark, sf_dir), "doc_id", "quality")


# profiles


def _stats_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, sum(({c} IS NULL)::INT)::BIGINT AS nulls, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std,
round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75 FROM {t}"""


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(_stats_sql("lineitem", c) for c in _NUMBERS))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.column_stats(table(spark, sf_dir, "lineitem"), _NUMBERS)


@query("""WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
n AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
SELECT "column", value, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM n) WHERE rank <= 10""")
def categorical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.categorical_top(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, sum(({c} IS NULL)::INT)::BIGINT AS nulls, sum(({c} IS NOT NULL AND trim({c}::VARCHAR) = '')::INT)::BIGINT AS blanks,
round(sum(({c} IS NULL OR trim({c}::VARCHAR) = '')::INT) / count(*), 4) AS missing_ratio FROM documents LEFT JOIN labels USING (doc_id)""" for c in ("text", "quality", "toxic", "lang")))
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.missing(items(spark, sf_dir), ["text", "quality", "toxic", "lang"])


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, value, round((value - m) / s, 4) AS z FROM events, s WHERE abs(round((value - m) / s, 4)) > 2""")
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.zscore_outliers(table(spark, sf_dir, "events"), "event_id", "value", 2.0)


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders),
q AS (SELECT max(CASE WHEN k = n // 4 THEN v END) AS q1, max(CASE WHEN k = 3 * n // 4 THEN v END) AS q3 FROM r)
SELECT q1, q3, q1 - (q3 - q1) * 1.5::DOUBLE AS low, q3 + (q3 - q1) * 1.5::DOUBLE AS high FROM q""")
def iqr_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.iqr_fences(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""WITH r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events),
q AS (SELECT max(CASE WHEN k = n // 4 THEN v END) AS q1, max(CASE WHEN k = 3 * n // 4 THEN v END) AS q3 FROM r)
SELECT event_id, value FROM events, q WHERE value < q1 - (q3 - q1) * 1.5::DOUBLE OR value > q3 + (q3 - q1) * 1.5::DOUBLE""")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.iqr_outliers(table(spark, sf_dir, "events"), "event_id", "value")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, abs(round(corr({a}, {b}), 6)) > 0.7 AS high FROM lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]))
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.correlations(table(spark, sf_dir, "lineitem"), _NUMBERS)


def _impute_sql(fill: str) -> str:
    return f"""WITH g AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events), k AS (SELECT * FROM g WHERE value IS NOT NULL), f AS ({fill})
SELECT event_id, event_type, round(coalesce(value, fill), 6) AS value, value IS NULL AS was_missing FROM g LEFT JOIN f USING (event_type)"""


@query(_impute_sql("SELECT event_type, avg(value) AS fill FROM k GROUP BY 1"))
def imputed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.imputed(gapped(spark, sf_dir), "event_id", "value", "event_type", "mean")


@query(_impute_sql("SELECT event_type, value AS fill FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM k) WHERE r = n // 2 + 1"))
def imputed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.imputed(gapped(spark, sf_dir), "event_id", "value", "event_type", "median")


@query(_impute_sql("SELECT event_type, value AS fill FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, value) AS r FROM k GROUP BY 1, 2) WHERE r = 1"))
def imputed_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.imputed(gapped(spark, sf_dir), "event_id", "value", "event_type", "mode")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", array_to_string(list_filter([CASE WHEN sum(({c} IS NULL)::INT) / count(*) > 0.3 THEN 'many_nulls' END, CASE WHEN count(DISTINCT {c}) < 5 AND count(DISTINCT {c}) < 0.01 * count({c}) THEN 'low_variety' END,
CASE WHEN abs(stddev_pop({c}) / avg({c})) > 2 THEN 'high_variation' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents LEFT JOIN labels USING (doc_id)""" for c in ("quality", "toxic", "n_chars")))
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.quality_issues(items(spark, sf_dir), ["quality", "toxic", "n_chars"])


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS classes, max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 4) AS ratio, round(max(n) / min(n), 4) < 3 AS balanced FROM n""")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.label_balance(table(spark, sf_dir, "documents"), "lang")


@query("SELECT floor(c_acctbal / 1000.0)::BIGINT AS bucket, count(*) AS n FROM customer GROUP BY 1")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 1000.0)


# agreement


@query(f"""WITH {RATINGS}, b AS (SELECT a.annotator AS first, b.annotator AS second, a.label AS x, b.label AS y FROM ratings a JOIN ratings b USING (item) WHERE a.annotator < b.annotator),
o AS (SELECT first, second, count(*) AS items, sum((x = y)::INT) AS same FROM b GROUP BY ALL),
l AS (SELECT first, second, x AS label, count(*) AS p FROM b GROUP BY ALL), r AS (SELECT first, second, y AS label, count(*) AS q FROM b GROUP BY ALL),
c AS (SELECT first, second, sum(p * q) AS pq FROM l JOIN r USING (first, second, label) GROUP BY ALL),
k AS (SELECT first, second, items, same / items AS po, pq / (items * items) AS pe FROM o JOIN c USING (first, second) WHERE items >= 10), z AS (SELECT *, (po - pe) / (1 - pe) AS kappa FROM k)
SELECT first, second, items, round(po, 4) AS agreement, round(kappa, 4) AS kappa, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost_perfect' END AS meaning FROM z""")
def annotator_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.pairwise(ratings(spark, sf_dir), "item", "annotator", "label")


@query(f"""WITH {RATINGS}, p AS (SELECT item, label, count(*) AS n FROM ratings GROUP BY ALL), i AS (SELECT item, sum(n) AS r, sum(n * n) AS sq FROM p GROUP BY 1),
o AS (SELECT avg((sq - r) / (r * (r - 1))) AS po FROM i), t AS (SELECT label, sum(n) AS n FROM p GROUP BY 1), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM t)
SELECT round(po, 4) AS observed, round(pe, 4) AS expected, round((po - pe) / (1 - pe), 4) AS kappa FROM o, e""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.fleiss_kappa(ratings(spark, sf_dir), "item", "label")


@query(f"""WITH {RATINGS}, p AS (SELECT item, label, count(*) AS n FROM ratings GROUP BY ALL), i AS (SELECT item, sum(n) AS r, sum(n * n) AS sq FROM p GROUP BY 1),
o AS (SELECT sum(r * r - sq) / sum(r * (r - 1)) AS d FROM i WHERE r > 1), t AS (SELECT label, sum(n) AS n FROM p GROUP BY 1), e AS (SELECT 1 - sum(n * n) / (sum(n) * sum(n)) AS e FROM t)
SELECT round(1 - d / e, 4) AS alpha FROM o, e""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.krippendorff_alpha(ratings(spark, sf_dir), "item", "label")


@query(f"""WITH {RATINGS} SELECT item, count(*) AS annotators, count(DISTINCT label) AS labels, round(1 - 1 / count(DISTINCT label), 4) AS disagreement FROM ratings GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT label) > 1""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.disagreements(ratings(spark, sf_dir), "item", "label")


# time series

_GAPPED = "g AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
_DAILY = "d AS (SELECT event_type, ts::DATE AS day, sum(value) AS value FROM events GROUP BY ALL)"


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(avg(pow((value - m) / s, 3)), 4) AS skewness, round(avg(pow((value - m) / s, 4)) - 3, 4) AS kurtosis,
round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q75 FROM events JOIN s USING (event_type) GROUP BY 1""")
def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.statistics(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"""WITH {_GAPPED}, i AS (SELECT *, row_number() OVER w AS i FROM g WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
f AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, last_value(value IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS qi, first_value(value IGNORE NULLS) OVER a AS qv
FROM i WINDOW b AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, ts, event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN pi IS NULL THEN qv WHEN qi IS NULL THEN pv ELSE pv + (qv - pv) * (i - pi) / (qi - pi) END, 6) AS linear, round(pv, 6) AS forward, round(qv, 6) AS backward, value IS NULL AS filled FROM f""")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.interpolated(gapped(spark, sf_dir), "event_type", ["ts", "event_id"], "value")


@query(f"""WITH {_DAILY}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d), v AS (SELECT event_type, sum(x * x) AS v FROM c GROUP BY 1),
l AS (SELECT a.event_type, b.i - a.i AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.event_type = b.event_type AND b.i - a.i BETWEEN 1 AND 10 GROUP BY 1, 2)
SELECT event_type, lag::BIGINT AS lag, round(s / v, 6) AS acf, abs(round(s / v, 6)) > 0.2 AS significant FROM l JOIN v USING (event_type)""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.autocorrelation(daily(spark, sf_dir), "event_type", ["day"], "value").filter("acf is not null")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_type, event_id, round(abs(value - m) / s, 4) AS z FROM events JOIN s USING (event_type) WHERE round(abs(value - m) / s, 4) > 2""")
def series_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.anomalies(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 2.0)


@query(f"""WITH {_DAILY}, t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS trend FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
m AS (SELECT event_type, (i - 1) % 7 AS k, avg(value - trend) AS m FROM t GROUP BY 1, 2), s AS (SELECT event_type, k, m - avg(m) OVER (PARTITION BY event_type) AS s FROM m)
SELECT t.event_type, day, round(trend, 6) AS trend, round(s, 6) AS seasonal, round(value - trend - s, 6) AS residual FROM t JOIN s ON t.event_type = s.event_type AND (i - 1) % 7 = k""")
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.decomposed(daily(spark, sf_dir), "event_type", "day", "value")


@query("""WITH a AS (SELECT *, CASE WHEN coalesce(epoch(ts) - epoch(lag(ts) OVER w), 1e18) > 3600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT user_id, session::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM b GROUP BY 1, 2""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


# graphs and points


@query(f"""WITH {EDGES}, e AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges), d AS (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM e GROUP BY 1)
SELECT *, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


@query(f"""WITH {EDGES}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT id, count(*) AS degree FROM e GROUP BY 1), m AS (SELECT count(*) AS edges, 0::BIGINT AS loops FROM edges)
SELECT count(*) AS nodes, max(degree) AS max_degree, min(degree) AS min_degree, round(avg(degree), 4) AS avg_degree, first(edges) AS edges, first(loops) AS loops, round(first(edges) / (count(*) * (count(*) - 1)), 6) AS density FROM d, m""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.basic_metrics(edges(spark, sf_dir))


_ROUNDS = "".join(f", r{k} AS (SELECT id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / o) AS s FROM edges JOIN o USING (src) JOIN r{k - 1} ON src = id GROUP BY 1) ON id = dst)" for k in range(1, 6))


@query(f"""WITH {EDGES}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), o AS (SELECT src, count(*) AS o FROM edges GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v){_ROUNDS}
SELECT id, round(rank, 8) AS rank FROM r5""")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(edges(spark, sf_dir))


@query(f"""WITH {POINTS}, b AS (SELECT cloud, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM points GROUP BY 1),
f AS (SELECT cloud, avg(d) AS mean_distance, max(d) AS max_distance FROM (SELECT cloud, sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)) AS d FROM points JOIN b USING (cloud)) GROUP BY 1),
v AS (SELECT *, CASE WHEN ex = 0 THEN 1 ELSE ex END * CASE WHEN ey = 0 THEN 1 ELSE ey END * CASE WHEN ez = 0 THEN 1 ELSE ez END AS volume FROM b JOIN f USING (cloud))
SELECT cloud, n, round(cx, 5) AS cx, round(cy, 5) AS cy, round(cz, 5) AS cz, round(volume, 5) AS volume, round(n / volume, 4) AS density, round(mean_distance, 5) AS mean_distance, round(max_distance, 5) AS max_distance FROM v""")
def cloud_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.cloud_stats(cloud(spark, sf_dir), "cloud")


@query(f"""WITH {POINTS} SELECT cloud, trunc(x / 0.1::DOUBLE)::BIGINT AS vx, trunc(y / 0.1::DOUBLE)::BIGINT AS vy, trunc(z / 0.1::DOUBLE)::BIGINT AS vz, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z FROM points GROUP BY 1, 2, 3, 4""")
def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.voxels(cloud(spark, sf_dir), "cloud")


@query(f"""WITH {POINTS}, l AS (SELECT cloud, min(z) AS low, count(*) AS n FROM points GROUP BY 1) SELECT cloud, count(*) AS points, round(avg(z), 5) AS height, round(100 * count(*) / first(n), 4) AS percent FROM points JOIN l USING (cloud) WHERE z < low + 0.1::DOUBLE GROUP BY 1""")
def ground_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.ground(cloud(spark, sf_dir), "cloud")


@query(f"""WITH {POINTS}, b AS (SELECT cloud, min(z) AS low, max(z) AS high FROM points GROUP BY 1) SELECT cloud, least(floor((z - low) / ((high - low) / 5)), 4)::BIGINT AS segment, count(*) AS n FROM points JOIN b USING (cloud) WHERE high > low AND z < high GROUP BY 1, 2""")
def height_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.height_segments(cloud(spark, sf_dir), "cloud")


# curation


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 50 OFFSET 20")
def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.page(table(spark, sf_dir, "documents"), F.col("lang") == "en", [F.desc("doc_id")], 20).select("doc_id", "lang", "source")


@query("""SELECT source, count(*) AS items, sum(coalesce(quality = 1, false)::INT)::BIGINT AS good, sum((quality IS NOT NULL)::INT)::BIGINT AS labelled, sum((length(text) < 500)::INT)::BIGINT AS short FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.group_counts(items(spark, sf_dir), "source", {"good": F.col("quality") == 1, "labelled": F.col("quality").isNotNull(), "short": F.length("text") < 500})


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, 'reviewed'], lambda x: x IS NOT NULL), ',') AS labels, true AS is_labeled FROM documents LEFT JOIN labels USING (doc_id)""")
def labels_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.relabelled(items(spark, sf_dir), "labels", "add", ["reviewed"]).select("doc_id", F.array_join("labels", ",").alias("labels"), "is_labeled")


@query("""WITH f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(lower(trim(text)), ''))), e AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT doc_id, 'added' AS change FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT doc_id, 'removed' FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f)""")
def versions_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a version of the English documents to one of a document for each text."""
    d = table(spark, sf_dir, "documents")
    return curation.versions_diff(d.filter("lang = 'en'"), curation.first_copies(d, "doc_id", "text").filter("not is_duplicate"), "doc_id")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders)
SELECT o_orderkey, o_custkey, rank::INT AS rank FROM r WHERE o_orderdate < TIMESTAMP '1995-01-01' OR rank > 5""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1995-01-31").cast("timestamp_ntz")
    return curation.expired(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", now)


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 100")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.queue_order(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", "o_orderdate", 100).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("""WITH x AS (SELECT doc_id, source, md5(lower(trim(text))) AS hash FROM documents), f AS (SELECT hash, source, min(doc_id) AS first FROM x GROUP BY 1, 2)
SELECT x.doc_id, x.source, min(f.first) AS duplicate_of FROM x JOIN f ON x.hash = f.hash AND x.source <> f.source AND f.first < x.doc_id GROUP BY 1, 2""")
def cross_source_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.cross_group_copies(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(lower(trim(text)))) AS first, doc_id <> min(doc_id) OVER (PARTITION BY md5(lower(trim(text)))) AS is_duplicate FROM documents""")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.first_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query, vec_id, rank::INT AS rank, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@query("""SELECT doc_id, 'removed' AS change FROM documents d WHERE doc_id <> (SELECT min(doc_id) FROM documents e WHERE md5(lower(trim(e.text))) = md5(lower(trim(d.text))))""")
def copies_removed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kept = first_copies(spark, sf_dir).filter("not is_duplicate").select("doc_id")
    return curation.versions_diff(d, d.join(kept, "doc_id", "left_semi"), "doc_id")


@query("""SELECT * FROM (SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT (o_totalprice BETWEEN 10000 AND 300000) THEN 'total_range' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status_enum' END,
CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-') THEN 'priority_pattern' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders) WHERE errors <> ''""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"total_range": F.col("o_totalprice").between(10000, 300000), "status_enum": F.col("o_orderstatus").isin("F", "O"), "priority_pattern": F.col("o_orderpriority").rlike("^[1-5]-")}
    return curation.violations(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query("""SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1)) AS title, regexp_extract(html, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)', 1) AS description,
len(regexp_extract_all(html, '(?i)<a [^>]*href='))::BIGINT AS links, len(regexp_extract_all(html, '(?i)<img[ />]'))::BIGINT AS images, len(regexp_extract_all(html, '(?i)<h[1-6][ >]'))::BIGINT AS headings, len(regexp_extract_all(html, '(?i)<p[ >]'))::BIGINT AS paragraphs FROM pages""")
def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.meta_tags(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.domain_counts(table(spark, sf_dir, "pages"), "url")


# exports, similarity, augmentation, scheduling


@query("""SELECT '{"id":' || doc_id || ',"lang":' || to_json(lang)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' AS value FROM documents""")
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.json_lines(table(spark, sf_dir, "documents"), "doc_id", "text", ["lang", "source"])


@query("""SELECT doc_id::VARCHAR AS id, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), '|') AS labels, text AS content FROM documents LEFT JOIN labels USING (doc_id)""")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.csv_rows(items(spark, sf_dir), "doc_id", "text", "labels")


@query("SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_brand AS name FROM part)")
def coco_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.coco_categories(table(spark, sf_dir, "part"), "p_brand")


@query(f"""WITH {EDGES} SELECT '<edge source="' || src || '" target="' || dst || '"/>' AS value FROM edges""")
def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.graphml_edges(edges(spark, sf_dir))


@query(f"WITH {POINTS} SELECT cloud, printf('%.6f %.6f %.6f', x, y, z) AS value FROM points")
def ply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ply_lines(cloud(spark, sf_dir))


def _ascii(column: str) -> Column:
    """DuckDB's edit distance counts bytes, Spark's characters: both are given texts in which they are the same."""
    return F.regexp_replace(column, "[^ -~]", "?")


_BENCH_WORDS = "list_distinct(regexp_extract_all(lower({0}.text), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""SELECT a.item_id, b.item_id AS other, round(len(list_intersect({_BENCH_WORDS.format('a')}, {_BENCH_WORDS.format('b')})) / len(list_distinct(list_concat({_BENCH_WORDS.format('a')}, {_BENCH_WORDS.format('b')}))), 6) AS jaccard,
round(1 - levenshtein(regexp_replace(a.text, '[^ -~]', '?', 'g'), regexp_replace(b.text, '[^ -~]', '?', 'g')) / greatest(length(a.text), length(b.text)), 6) AS levenshtein FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("next"))
    return a.join(b, "item_id").select("item_id", "other", F.round(similarity.word_jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"), F.round(similarity.levenshtein_similarity(_ascii("text"), _ascii("next")), 6).alias("levenshtein"))


@query("""WITH g AS (SELECT DISTINCT item_id, substring(lower(trim(text)), i, 3) AS g FROM (SELECT item_id, text, unnest(range(1, greatest(length(trim(text)) - 1, 1))) AS i FROM benchmark) WHERE length(trim(text)) >= 3), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.item_id, b.item_id AS other, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND b.item_id = a.item_id + 1 GROUP BY 1, 2)
SELECT a.item_id, b.item_id AS other, round(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)), 6) AS similarity FROM n a JOIN n b ON b.item_id = a.item_id + 1 LEFT JOIN c ON c.item_id = a.item_id""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("text").alias("next"))
    return a.join(b, "item_id").select("item_id", "other", F.round(similarity.ngram_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


_CHANCE = "(('0x' || substring(md5('0:' || {key} || ':' || ({place})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_SPACED = PIECES.format(t="text").replace("lower(text)", "text")


@query(f"""WITH w AS (SELECT doc_id, {_SPACED} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM u WHERE {_CHANCE.format(key='doc_id', place='i')} >= 0.1::DOUBLE GROUP BY 1)
SELECT doc_id, coalesce(text, w[1], '') AS text FROM w LEFT JOIN k USING (doc_id)""")
def words_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.random_deletion(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, {_SPACED} AS w FROM documents), p AS (SELECT doc_id, w, floor({_CHANCE.format(key='doc_id', place='-1')} * len(w))::INT + 1 AS i, floor({_CHANCE.format(key='doc_id', place='-2')} * len(w))::INT + 1 AS j FROM w)
SELECT doc_id, array_to_string(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN k = i THEN w[j] WHEN k = j THEN w[i] ELSE w[k] END), ' ') AS text FROM p""")
def words_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.random_swap(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH x AS (SELECT doc_id AS augmented_from, unnest(range(1, 4)) AS copy FROM documents)
SELECT augmented_from, copy::INT AS copy, CASE WHEN {_CHANCE.format(key='augmented_from', place='copy')} < 0.5::DOUBLE THEN 'deletion' ELSE 'swap' END AS augmentation_type FROM x""")
def augmentation_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augmentation.augmented(table(spark, sf_dir, "documents"), "doc_id", 3)


@query("""SELECT event_id, least(2.0::DOUBLE * pow(2, event_id % 8), 100::DOUBLE) AS exponential, least(2.0::DOUBLE * (event_id % 8 + 1), 100::DOUBLE) AS linear,
least(2.0::DOUBLE * [1, 2, 3, 5, 8, 13, 21, 34][(event_id % 8 + 1)::INT], 100::DOUBLE) AS fibonacci, strftime(ts, '%H:%M:%S') BETWEEN '22:00:00' AND '23:59:59' AS blackout FROM events""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("event_id") % 8).cast("int")
    return table(spark, sf_dir, "events").select("event_id", schedule.exponential_delay(k, 2.0, 100.0).alias("exponential"), schedule.linear_delay(k, 2.0, 100.0).alias("linear"), schedule.fibonacci_delay(k, 2.0, 100.0).alias("fibonacci"), schedule.in_blackout(F.col("ts"), "22:00:00", "23:59:59").alias("blackout"))


@query("""SELECT o_orderstatus, year(o_orderdate)::INT AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, year(o_orderdate))""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), h AS (SELECT 'c1' AS id, 0 AS hops UNION SELECT dst, hops + 1 FROM e JOIN h ON src = id WHERE hops < 6)
SELECT id, min(hops)::INT AS hops FROM h GROUP BY 1""")
def hops_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hops(edges(spark, sf_dir), "c1")


@query(f"""WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT 'r' || r_regionkey AS id FROM region),
n AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS root FROM nation), l AS (SELECT 'c' || c_custkey AS id, root FROM customer JOIN n ON n.id = 'n' || c_nationkey UNION ALL SELECT 's' || s_suppkey, root FROM supplier JOIN n ON n.id = 'n' || s_nationkey UNION ALL SELECT id, root FROM n UNION ALL SELECT DISTINCT root, root FROM n)
SELECT id, min(id) OVER (PARTITION BY root) AS component FROM l""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(edges(spark, sf_dir))
