"""Series as rows (series, time, tie-breaker, value), one window per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.operators import quantiles


def statistics(df: DataFrame, series: str, value: str) -> DataFrame:
    """Moments and quartiles of each series, skewness and excess kurtosis of the population."""
    v = F.col(value)
    q = _quartiles(df, series, value)
    moments = df.groupBy(series).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.coalesce(F.skewness(v), F.lit(0.0)), 4).alias("skewness"), F.round(F.coalesce(F.kurtosis(v), F.lit(0.0)), 4).alias("kurtosis"))
    return moments.withColumn("g", quantiles.group_key(series)).join(q, "g", "left").select(*moments.columns, *(F.round(c, 4).alias(c) for c in ("q25", "median", "q75")))


def _quartiles(df: DataFrame, series: str, value: str) -> DataFrame:
    """g, q25, median, q75 of each series."""
    return quantiles.percentiles(df.filter(F.col(value).isNotNull()).select(quantiles.group_key(series).alias("g"), F.col(value).alias("v")), {"q25": 0.25, "median": 0.5, "q75": 0.75})


def interpolated(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Gaps filled forward, backward and linearly by place, flat beyond the ends. order begins with a time.

    Rows are filled within their day; the nearest known values of other days come from one row a day.
    """
    day = F.to_date(order[0])
    back = Window.partitionBy(series, "day").orderBy(*order)
    ahead = Window.partitionBy(series, "day").orderBy(*(F.desc(c) for c in order))
    x = df.select(series, *order, value, day.alias("day")).withColumn("i", F.row_number().over(back))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("i"), F.col(value).alias("v")))
    x = x.withColumn("p", F.last(known, ignorenulls=True).over(back)).withColumn("q", F.last(known, ignorenulls=True).over(ahead))

    days = x.groupBy(series, "day").agg(F.count("*").alias("n"), F.min(known).alias("first"), F.max(known).alias("last"))
    by_day = Window.partitionBy(series).orderBy("day")
    days = days.withColumn("before", F.sum("n").over(by_day) - F.col("n"))

    def placed(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct((F.col(c)["i"] + F.col("before")).alias("i"), F.col(c)["v"].alias("v")))

    days = days.withColumn("earlier", F.last(placed("last"), ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)))
    days = days.withColumn("later", F.last(placed("first"), ignorenulls=True).over(Window.partitionBy(series).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)))
    days = days.select(F.col(series).alias("s"), F.col("day").alias("d"), "before", "earlier", "later")
    x = x.join(days, x[series].eqNullSafe(F.col("s")) & x["day"].eqNullSafe(F.col("d")))
    x = x.withColumns({"p": F.coalesce(placed("p"), "earlier"), "q": F.coalesce(placed("q"), "later"), "i": F.col("i") + F.col("before")})
    linear = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("p").isNull(), F.col("q.v")).when(F.col("q").isNull(), F.col("p.v"))
    linear = linear.otherwise(F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("i") - F.col("p.i")) / (F.col("q.i") - F.col("p.i")))
    return x.select(series, *order, F.round(linear, 6).alias("linear"), F.round("p.v", 6).alias("forward"), F.round("q.v", 6).alias("backward"), F.col(value).isNull().alias("filled"))


def detected_period(df: DataFrame, series: str, order: list[str], value: str, most: int = 100) -> DataFrame:
    """The first lag from 2 on whose autocorrelation is over a half; null where there's none."""
    acf = autocorrelation(df, series, order, value, most)
    return acf.groupBy(series).agg(F.min(F.when((F.col("lag") >= 2) & (F.col("acf") > 0.5), F.col("lag"))).alias("period"))


def autocorrelation(df: DataFrame, series: str, order: list[str], value: str, lags: int = 10) -> DataFrame:
    """Autocorrelation at each lag, and whether it is over 0.2 in size."""
    w = Window.partitionBy(series)
    x = df.filter(F.col(value).isNotNull()).withColumn("d", F.col(value) - F.avg(value).over(w))
    placed = Window.partitionBy(series).orderBy(*order)
    ahead = x.select(series, "d", F.array(*(F.lag("d", k).over(placed) for k in range(1, lags + 1))).alias("before")).select(series, "d", F.posexplode("before").alias("k", "e"))
    out = ahead.groupBy(series, (F.col("k") + 1).alias("lag")).agg((F.sum(F.col("d") * F.col("e")) / F.sum(F.col("d") * F.col("d"))).alias("acf"))
    return out.select(series, F.col("lag").cast("long").alias("lag"), F.round("acf", 6).alias("acf"), (F.abs("acf") > 0.2).alias("significant"))


def anomalies(df: DataFrame, series: str, key: str, value: str, threshold: float = 3.0) -> DataFrame:
    """Values over so many deviations from their series' mean."""
    stats = df.groupBy(series).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = F.abs(F.col(value) - F.col("m")) / F.col("s")
    return df.join(stats, series).filter("s > 0").select(series, key, F.round(z, 4).alias("z")).filter(F.col("z") > threshold)


def decomposed(df: DataFrame, series: str, time: str, value: str, period: int = 7) -> DataFrame:
    """Additive trend (centred mean of an odd period), seasonal means and residual of a regular series."""
    half = period // 2
    w = Window.partitionBy(series).orderBy(time)
    near = w.rowsBetween(-half, half)
    x = df.select(series, time, value, F.row_number().over(w).alias("i"), F.when(F.count(value).over(near) == period, F.avg(value).over(near)).alias("trend"))
    season = x.withColumn("k", (F.col("i") - 1) % period).withColumn("off", F.col(value) - F.col("trend"))
    means = season.groupBy(series, "k").agg(F.avg("off").alias("mean"))
    centred = means.withColumn("seasonal", F.col("mean") - F.avg("mean").over(Window.partitionBy(series)))
    out = season.join(centred, [series, "k"])
    return out.select(series, time, F.round("trend", 6).alias("trend"), F.round("seasonal", 6).alias("seasonal"), F.round(F.col(value) - F.col("trend") - F.col("seasonal"), 6).alias("residual"))


def sessions(df: DataFrame, user: str, time: str, key: str, gap_seconds: int) -> DataFrame:
    """Runs of a user's events with no longer gap than that: start, end and size."""
    w = Window.partitionBy(user).orderBy(time, key)
    second = F.col(time).cast("timestamp").cast("double")
    x = df.withColumn("new", (F.coalesce(second - F.lag(second).over(w), F.lit(1e18)) > gap_seconds).cast("long"))
    x = x.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(user, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("events"))


def iqr_anomalies(df: DataFrame, series: str, key: str, value: str, multiplier: float = 3.0) -> DataFrame:
    """Values beyond the quartiles (interpolated) by so many interquartile ranges."""
    q = _quartiles(df, series, value)
    width = (F.col("q75") - F.col("q25")) * multiplier
    x = df.filter(F.col(series).isNotNull()).select(series, key, value, quantiles.group_key(series).alias("g")).join(q, "g")
    return x.filter((F.col(value) < F.col("q25") - width) | (F.col(value) > F.col("q75") + width)).select(series, key, value)


def seasonal_strength(df: DataFrame, series: str, time: str, value: str, period: int = 7) -> DataFrame:
    """How much of what the trend leaves, and of what the season leaves, isn't residual: 0 to 1 each."""
    parts = decomposed(df, series, time, value, period).filter("residual is not null")
    v = parts.groupBy(series).agg(*(F.var_pop(c).alias(c) for c in ("trend", "seasonal", "residual")))
    share = {k: F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("residual"), F.col("residual") + F.col(k))) for k in ("trend", "seasonal")}
    return v.select(series, *(F.round(c, 4).alias(f"{k}_strength") for k, c in share.items()))


def aligned_groups(df: DataFrame, group: str, time: str, key: str, kind: str, gap_seconds: int = 60) -> DataFrame:
    """Runs of a group's items with no longer gap than that, of two items and two kinds at least."""
    w = Window.partitionBy(group).orderBy(time, key)
    second = F.col(time).cast("timestamp").cast("double")
    x = df.withColumn("new", (F.coalesce(second - F.lag(second).over(w), F.lit(1e18)) > gap_seconds).cast("long"))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(group, "run").agg(F.min(time).alias("start"), F.count("*").alias("items"), F.count_distinct(kind).alias("kinds")).filter("items >= 2 and kinds >= 2")
