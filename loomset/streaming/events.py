"""Streams of events: windowed counts, first arrivals, changes, limits and breakers. Each takes and returns a streaming frame.

Keyed state sees a batch's rows of its key in the order of time and event_id; a row that comes in a later batch counts
when it comes. What a key has in one batch is in memory at once; fewer files a batch make that less.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    read = spark.readStream.schema(EVENT.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; a window is out once the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_arrivals(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")


def _micros(pdf: pd.DataFrame) -> list[int]:
    return pdf["ts"].astype("datetime64[us]").astype("int64").tolist()


def changes(events: DataFrame, key: str, value: str) -> DataFrame:
    """A row whenever a key's value differs from the one before; state is one value for each key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = _in_order(batches)
        now = pdf[value].astype(str)
        was = now.shift(1)
        was.iloc[0] = state.get[0] if state.exists else None
        out = pdf[was != now]
        state.update((now.iloc[-1],))
        yield pd.DataFrame({key: k[0], "event_id": out["event_id"], "value": out[value].astype(str)})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "ts", value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, value string", "last string", "append", GroupStateTimeout.NoTimeout)


def rate_limited(events: DataFrame, client: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Whether each request is allowed: fewer than `limit` allowed ones in the last `seconds` of its client.

    State is the times of the allowed requests in the window, `limit` at most.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        pdf = _in_order(batches)
        said = []
        for t in _micros(pdf):
            times = [x for x in times if x > t - seconds * 1_000_000]
            said.append(len(times) < limit)
            if said[-1]:
                times.append(t)
        state.update((times,))
        yield pd.DataFrame({client: k[0], "event_id": pdf["event_id"], "allowed": said})

    kind = events.schema[client].dataType.simpleString()
    return events.select(client, "event_id", "ts").groupBy(client).applyInPandasWithState(step, f"{client} {kind}, event_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, key: str, failed: Column, failures: int = 5, reset_seconds: float = 60.0, trials: int = 3) -> DataFrame:
    """key, event_id, allowed and state after each call, of a breaker for each key.

    So many failures in a row open it. Calls are then refused, and leave no trace, until the last failure is
    `reset_seconds` past; it is half-open after that, until so many calls succeed (closed) or one fails (open). A call
    whose `failed` is null succeeded.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, now, tried = state.get if state.exists else (0, 0, "closed", 0)
        pdf = _in_order(batches)
        allowed, states = [], []
        for t, bad in zip(_micros(pdf), pdf["failed"].tolist(), strict=True):
            if now == "open" and t - last >= reset_seconds * 1_000_000:
                now, tried = "half-open", 0
            allowed.append(now != "open")
            if allowed[-1] and bad:
                count, last = count + 1, t
                now = "open" if now == "half-open" or count >= failures else now
            elif allowed[-1] and now == "half-open":
                tried += 1
                now, count = ("closed", 0) if tried >= trials else (now, count)
            elif allowed[-1]:
                count = 0
            states.append(now)
        state.update((count, last, now, tried))
        yield pd.DataFrame({key: k[0], "event_id": pdf["event_id"], "allowed": allowed, "state": states})

    kind = events.schema[key].dataType.simpleString()
    calls = events.select(key, "event_id", "ts", F.coalesce(failed, F.lit(False)).alias("failed"))
    return calls.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, allowed boolean, state string", "count long, last long, state string, tried long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now into Parquet files, and reads those."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
