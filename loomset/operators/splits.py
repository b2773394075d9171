"""Train, validation and test splits, and checks that nothing leaks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _named(place: Column, total: Column, train: float, val: float) -> Column:
    """train for the first int(n * train) places (from 1), val for the next int(n * val), test for the rest."""
    a, b = F.floor(total * train), F.floor(total * val)
    return F.when(place <= a, "train").when(place <= a + b, "val").otherwise("test")


def shuffled_by(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def auto_split(items: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Exact ratios in a seeded order.

    Places come without a global sort in one task: ranks inside 256 hash ranges, plus the sizes of the ranges before.
    """
    h = items.select(key, shuffled_by(key, seed).alias("h")).withColumn("part", F.substring("h", 1, 2))
    sizes = h.groupBy("part").agg(F.count("*").alias("n"))  # 256 rows at most
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = h.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("h", key))).join(F.broadcast(before), "part")
    return placed.select(key, _named(F.col("rank") + F.col("before"), F.col("total"), train, val).alias("split"))


def stratified_split(items: DataFrame, key: str, stratum: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """The ratios within each stratum; its places come from hash ranges as in auto_split()."""
    h = items.select(key, stratum, shuffled_by(key, seed).alias("h")).withColumn("part", F.substring("h", 1, 2))
    sizes = h.groupBy(stratum, "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy(stratum)
    before = sizes.select(F.col(stratum).alias("s"), F.col("part").alias("p"), (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    placed = h.withColumn("rank", F.row_number().over(Window.partitionBy(stratum, "part").orderBy("h", key)))
    placed = placed.join(before, placed[stratum].eqNullSafe(before["s"]) & (placed["part"] == before["p"]))
    return placed.select(key, stratum, _named(F.col("rank") + F.col("before"), F.col("total"), train, val).alias("split"))


def split_stats(items: DataFrame, split: str, label: str) -> DataFrame:
    """Rows of each label by split, one column each."""
    return items.groupBy(label).agg(*(F.count_if(F.col(split) == s).alias(s) for s in ("train", "val", "test")), F.count("*").alias("total"))


def temporal_split(items: DataFrame, key: str, time: str, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Oldest rows train, newest test, cut at exact counts.

    Rows are ranked within their day; the days before, which are few, give the rest of the place.
    """
    days = items.select(key, time, F.to_date(time).alias("day"))
    w = Window.orderBy("day")
    before = days.groupBy("day").agg(F.count("*").alias("n")).select("day", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = days.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(time, key))).join(before, "day")
    return placed.select(key, _named(F.col("rank") + F.col("before"), F.col("total"), train, val).alias("split"))


def sliding_windows(items: DataFrame, time: str, window_days: int = 14, step_days: int = 7, horizon_days: int = 7) -> DataFrame:
    """Train and test counts of windows that slide over the time span, as long as the test part ends within it."""
    day = items.select(F.to_date(time).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    span = day.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    starts = span.select("high", F.explode(F.sequence("low", "high", F.expr(f"interval {step_days} day"))).alias("start"))
    starts = starts.filter(F.date_add("start", window_days + horizon_days) <= F.date_add("high", 1))
    met = starts.join(day, (F.col("day") >= F.col("start")) & (F.col("day") < F.date_add("start", window_days + horizon_days)))
    return met.groupBy("start").agg(
        F.coalesce(F.sum(F.when(F.col("day") < F.date_add("start", window_days), F.col("n"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(F.col("day") >= F.date_add("start", window_days), F.col("n"))), F.lit(0)).alias("test_rows"),
    )


def exact_leakage(items: DataFrame, key: str, content: str, split: str) -> DataFrame:
    """Contents that several splits have: the last row of each split that has it, by pairs of splits."""
    text = F.regexp_replace(F.trim(F.lower(F.col(content))), r"[ \t\n\x0B\f\r]+", " ")
    last = items.select(key, split, F.md5(text).alias("hash")).groupBy("hash", split).agg(F.max(key).alias("id"))
    order = F.create_map(F.lit("train"), F.lit(0), F.lit("val"), F.lit(1), F.lit("test"), F.lit(2))
    a = last.select("hash", F.col(split).alias("split1"), F.col("id").alias("id1"))
    b = last.select("hash", F.col(split).alias("split2"), F.col("id").alias("id2"))
    return a.join(b, "hash").filter(order[F.col("split1")] < order[F.col("split2")])


def source_leakage(items: DataFrame, source: str, split: str) -> DataFrame:
    """Sources that train shares with another split, with counts; ten train rows make it severe."""
    n = items.groupBy(source, split).agg(F.count("*").alias("n"))
    train = n.filter(F.col(split) == "train").select(source, F.col("n").alias("train_rows"))
    other = n.filter(F.col(split) != "train").select(source, F.col(split).alias("other"), F.col("n").alias("other_rows"))
    return train.join(other, source).withColumn("severity", F.when(F.col("train_rows") >= 10, "high").otherwise("medium"))


def temporal_leakage(items: DataFrame, time: str, split: str) -> DataFrame:
    """Train rows newer than the first row of another split."""
    lows = items.filter(F.col(split) != "train").groupBy(F.col(split).alias("other")).agg(F.min(time).alias("low"))
    newer = items.filter(F.col(split) == "train").join(F.broadcast(lows), F.col(time) > F.col("low"))  # two rows at most
    out = newer.groupBy("other").agg(F.count("*").alias("overlap"))
    return out.withColumn("severity", F.when(F.col("overlap") > 100, "high").otherwise("medium"))


def active_learning(items: DataFrame, key: str, quality: str, top: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The rows of most uncertainty, which is one minus the quality (0.5 if unknown)."""
    u = 1 - F.coalesce(F.when(F.col(quality) != 0, F.col(quality).cast("double")), F.lit(0.5))
    return items.select(key, u.alias("uncertainty")).filter(F.col("uncertainty").between(low, high)).orderBy(F.desc("uncertainty"), key).limit(top)
