"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import decontamination, hard_negatives, line_dedup, media, ngram_join, packing, pii, quality, substring_dedup, suffix_dedup, tool_calls, wacz, whitening
from loomset.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_echoes")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.dedup_words(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.stored_text(table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns(table(spark, sf_dir, "conversations"))
    out = tool_calls.linked(calls, results, tool_calls.turn_schemas(spark))
    return out.select("conv_id", "call_id", "turn", "result_turn", F.col("level").cast("long").alias("level"), "status", F.size("errors").cast("long").alias("n_errors"), "json")


def op10_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_quality, op3_ngram_join, op4_decontamination, op5_suffix_dedup, op6_substring_dedup, op7_media, op8_packing, op9_tool_calls, op10_wacz, op11_whitening, op12_line_dedup, op13_hard_negatives)
}

ORACLE_SQL: dict[str, str] = {
    "op9_tool_calls": """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (
  SELECT *, last_value(CASE WHEN role <> 'assistant' THEN turn END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked
  FROM said),
calls AS (
  SELECT conv_id, turn, role AS name, text, conv_id || ':' || turn AS call_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level
  FROM placed WHERE role <> 'assistant'),
answers AS (
  SELECT conv_id, conv_id || ':' || coalesce(asked::VARCHAR, 'null') AS call_id, min(turn) AS result_turn,
    arg_min(text, turn) AS content, count(*) AS n
  FROM placed WHERE role = 'assistant' GROUP BY 1, 2),
met AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.turn, a.result_turn, c.level,
    CASE WHEN c.call_id IS NULL THEN 'no call' WHEN a.call_id IS NULL THEN 'no result' ELSE 'linked' END AS status,
    CASE WHEN a.n > 1 THEN 1 ELSE 0 END AS n_errors, c.name, c.text, a.content
  FROM calls c FULL JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id)
SELECT conv_id, call_id, turn, result_turn, level::BIGINT AS level, status, n_errors::BIGINT AS n_errors,
  '{' || CASE WHEN text IS NULL THEN '' ELSE '"arguments":{"text":' || to_json(text)::VARCHAR || '},' END
  || CASE WHEN content IS NULL THEN '' ELSE '"content":' || to_json(content)::VARCHAR || ',' END
  || '"errors":[' || CASE WHEN n_errors > 0 THEN '"repeated result"' ELSE '' END || '],"id":' || to_json(call_id)::VARCHAR
  || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END
  || CASE WHEN name IS NULL THEN '' ELSE ',"name":' || to_json(name)::VARCHAR END || ',"status":"' || status || '"}' AS json
FROM met
""",
    "op12_line_dedup": """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op13_hard_negatives": """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
}
