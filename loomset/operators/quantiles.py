"""Order statistics of groups of any size: no task holds a group's distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 1024


def group_key(*columns: str) -> Column:
    """A string for a row's group; null is a group."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def at_places(values: DataFrame, places: dict[str, Column], levels: int = 2) -> DataFrame:
    """g, n and, by name, the values at some places (from 0, columns of n) of each group. values: g, v; neither is null.

    Values are counted first. At each level the range that holds a place is cut into 1,024 equal ones between its
    own least and largest value, so a far value only costs a level; counts of the ranges tell which of them holds the
    place. The distinct values of that last range are sorted. Where the ends aren't finite a range isn't cut.
    """
    rest = values.groupBy("g", "v").agg(F.count("*").alias("c")).withColumn("path", F.lit(0).cast("long"))
    n = rest.groupBy("g").agg(F.sum("c").alias("n"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in places.items()))
    want = n.withColumn("a", F.explode(asked)).select("g", F.lit(0).cast("long").alias("path"), "a.name", "a.k", "n")
    at = F.col("v").cast("double")
    for _ in range(levels):
        ends = rest.groupBy("g", "path").agg(F.min(at).alias("least"), F.max(at).alias("most"))
        share = F.nanvl(F.coalesce(F.try_divide(at - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0)), F.lit(0.0))
        rest = rest.join(ends, ["g", "path"]).select("g", (F.col("path") * PARTS + F.floor(share * (PARTS - 1))).alias("path"), F.col("path").alias("of"), "v", "c")
        sums = rest.groupBy("g", "of", "path").agg(F.sum("c").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("g", "of").orderBy("path"))
        found = _found(want, sums.withColumn("upto", upto).select("g", F.col("of").alias("path"), F.col("path").alias("next"), (F.col("upto") - F.col("s")).alias("before"), "upto"))
        want = found.select("g", F.col("next").alias("path"), "name", (F.col("k") - F.col("before")).alias("k"), "n")
        rest = rest.select("g", "path", "v", "c").join(want.select("g", "path").distinct(), ["g", "path"], "left_semi")
    upto = F.sum("c").over(Window.partitionBy("g", "path").orderBy("v"))
    last = _found(want, rest.withColumn("upto", upto).select("g", "path", "v", (F.col("upto") - F.col("c")).alias("before"), "upto"))
    return last.groupBy("g", "n").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places))


def _found(want: DataFrame, ranges: DataFrame) -> DataFrame:
    return want.join(ranges, ["g", "path"]).filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("upto")))


def percentiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """g and, by name, percentiles of each group, interpolated between the two nearest values. values: g, v, as in at_places()."""
    place = {name: (F.col("n") - 1) * q for name, q in shares.items()}
    near = at_places(values, {f"{name}_{side}": of(p) for name, p in place.items() for side, of in (("low", F.floor), ("high", F.ceil))})

    def between(name: str) -> Column:
        low, high = F.col(f"{name}_low").cast("double"), F.col(f"{name}_high").cast("double")
        part = place[name] - F.floor(place[name])
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return near.select("g", *(between(name).alias(name) for name in shares))
