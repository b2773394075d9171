"""Queries that run over the events as a stream, to its end, and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators.shared import shared_dir
from loomset.plans.catalog import query
from loomset.streaming import events


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = shared_dir(spark)
    return events.drained(stream, f"{folder}/rows", f"{folder}/state")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_stream(spark, f"{sf_dir}/events.parque[t]")  # a pattern, since a stream takes folders and patterns only


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, events.windowed_counts(_stream(spark, sf_dir)))


@query("""SELECT user_id, event_id, event_type AS value FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS NULL OR was <> event_type""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, events.changes(_stream(spark, sf_dir), "user_id", "event_type"))


@query()
def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, events.rate_limited(_stream(spark, sf_dir), "user_id", 3, 12 * 3600))


@query()
def stream_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, events.breaker(_stream(spark, sf_dir), "user_id", F.col("event_type") == "error", 2, 24 * 3600, 2))
