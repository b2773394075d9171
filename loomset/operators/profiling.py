"""Profiles of numeric and categorical columns: statistics, outliers, missing values, correlation, imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.operators import quantiles


def _one_by_one(df: DataFrame, columns: list[str], of) -> DataFrame:
    """One row for each column, all out of a single aggregate over the table."""
    aggs = df.agg(*(F.struct(*of(c)).alias(c) for c in columns))
    return aggs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))).alias("r")).select("r.column", "r.x.*")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, range, mean and deviation (of the population) and quartiles (interpolated) of numeric columns."""

    def of(c: str) -> list:
        v = F.col(c).cast("double")
        return [F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std")]

    each = F.explode(F.array(*(F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("v")) for c in columns)))
    quartiles = quantiles.percentiles(df.select(each.alias("r")).select("r.*").filter("v is not null"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    quartiles = quartiles.select(F.col("g").alias("column"), *(F.round(q, 4).alias(q) for q in ("q25", "median", "q75")))
    return _one_by_one(df, columns, of).join(quartiles, "column", "left")


def categorical_top(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """The most frequent values of each column, ties by value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("r")).select("r.*")
    n = long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= top)


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and blank strings of each column and their share."""

    def of(c: str) -> list:
        blank = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) == "")
        gone = F.count_if(F.col(c).isNull() | blank)
        return [F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(blank).alias("blanks"), F.round(F.try_divide(gone, F.count("*")), 4).alias("missing_ratio")]

    return _one_by_one(df, columns, of)


def zscore_outliers(df: DataFrame, key: str, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows over so many deviations (of the population) from the mean."""
    one = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = (F.col(value) - F.col("m")) / F.col("s")
    return df.crossJoin(F.broadcast(one)).filter("s > 0").select(key, value, F.round(z, 4).alias("z")).filter(F.abs("z") > threshold)  # a row of two numbers


def iqr_fences(df: DataFrame, value: str, multiplier: float = 1.5) -> DataFrame:
    """The lower and upper quartile as the n div 4-th and 3n div 4-th value (from 0), and the fences around them."""
    values = df.filter(F.col(value).isNotNull()).select(F.lit("").alias("g"), F.col(value).alias("v"))
    q = quantiles.at_places(values, {"q1": F.expr("n div 4"), "q3": F.expr("3 * n div 4")})
    fence = (F.col("q3") - F.col("q1")) * multiplier
    return q.filter("n >= 4").select("q1", "q3", (F.col("q1") - fence).alias("low"), (F.col("q3") + fence).alias("high"))


def iqr_outliers(df: DataFrame, key: str, value: str, multiplier: float = 1.5) -> DataFrame:
    return df.crossJoin(F.broadcast(iqr_fences(df, value, multiplier))).filter((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).select(key, value)  # one row of fences


def correlations(df: DataFrame, columns: list[str], high: float = 0.7) -> DataFrame:
    """Pearson's coefficient of every two columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in pairs))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.coalesce(F.col(f"`{a}~{b}`"), F.lit(0.0)), 6).alias("r")) for a, b in pairs))).alias("x"))
    return rows.select("x.*").withColumn("high", F.abs("r") > high)


def imputed(df: DataFrame, key: str, value: str, by: str, strategy: str = "mean") -> DataFrame:
    """Nulls of a column replaced by the mean, upper median or most frequent value of their group."""
    known = df.filter(F.col(value).isNotNull())
    if strategy == "mean":
        fill = known.groupBy(by).agg(F.avg(value).alias("fill"))
    elif strategy == "median":
        middle = quantiles.at_places(known.select(quantiles.group_key(by).alias("g"), F.col(value).alias("v")), {"fill": F.expr("n div 2")})
        fill = known.select(by).distinct().withColumn("g", quantiles.group_key(by)).join(middle, "g").select(by, "fill")
    else:
        n = known.groupBy(by, value).agg(F.count("*").alias("n"))
        fill = n.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("fill"))
    return df.join(fill, by, "left").select(key, by, F.round(F.coalesce(value, "fill"), 6).alias("value"), F.col(value).isNull().alias("was_missing"))


def quality_issues(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of many nulls, of hardly any variety, or of high variation."""

    def of(c: str) -> list:
        v = F.col(c).cast("double")
        return [F.try_divide(F.count_if(F.col(c).isNull()), F.count("*")).alias("nulls"), F.count_distinct(c).alias("kinds"), F.count(c).alias("n"), F.abs(F.try_divide(F.stddev_pop(v), F.avg(v))).alias("cv")]

    x = _one_by_one(df, columns, of)
    issue = F.array_compact(F.array(F.when(F.col("nulls") > 0.3, F.lit("many_nulls")), F.when((F.col("kinds") < 5) & (F.col("kinds") < 0.01 * F.col("n")), F.lit("low_variety")), F.when(F.col("cv") > 2, F.lit("high_variation"))))
    return x.select("column", F.array_join(issue, ",").alias("issues"))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Largest and smallest class and their ratio; under 3 counts as balanced."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    x = n.agg(F.count("*").alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return x.withColumn("ratio", F.round(F.try_divide("largest", "smallest"), 4)).withColumn("balanced", F.col("ratio") < 3)


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bucket")).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
