"""Agreement of annotators. Input: one row for each item and annotator, with a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interpreted(kappa: Column) -> Column:
    out = F.when(kappa < 0, "poor")
    for below, name in ((0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")):
        out = out.when(kappa < below, name)
    return out.otherwise("almost_perfect")


def pairwise(ratings: DataFrame, item: str, annotator: str, label: str, least: int = 10) -> DataFrame:
    """Share of agreement and Cohen's kappa of every two annotators with enough items in common."""
    a = ratings.select(item, F.col(annotator).alias("first"), F.col(label).alias("x"))
    b = ratings.select(item, F.col(annotator).alias("second"), F.col(label).alias("y"))
    both = a.join(b, item).filter("first < second")
    cells = both.groupBy("first", "second", "x", "y").agg(F.count("*").alias("n"))
    agreed = cells.groupBy("first", "second").agg(F.sum("n").alias("items"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("first", "second", F.col("x").alias("label")).agg(F.sum("n").alias("p"))
    right = cells.groupBy("first", "second", F.col("y").alias("label")).agg(F.sum("n").alias("q"))
    chance = left.join(right, ["first", "second", "label"]).groupBy("first", "second").agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
    x = agreed.filter(F.col("items") >= least).join(chance, ["first", "second"], "left")
    po, pe = F.col("same") / F.col("items"), F.coalesce("pq", F.lit(0)) / (F.col("items") * F.col("items"))
    kappa = F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    return x.select("first", "second", "items", F.round(po, 4).alias("agreement"), F.round(kappa, 4).alias("kappa"), interpreted(kappa).alias("meaning"))


def fleiss_kappa(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa over items rated equally often."""
    per = ratings.groupBy(item, label).agg(F.count("*").alias("n"))
    items = per.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    mean = items.filter("r > 1").agg(F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"))
    total = per.groupBy(label).agg(F.sum("n").alias("n"))
    pe = total.agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("all")).select((F.col("sq") / (F.col("all") * F.col("all"))).alias("pe"))
    kappa = F.when(F.col("pe") == 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe")))
    return mean.crossJoin(pe).select(F.round("p", 4).alias("observed"), F.round("pe", 4).alias("expected"), F.round(kappa, 4).alias("kappa"))  # one row each


def krippendorff_alpha(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Nominal alpha: disagreeing pairs within items against those of all labels, with replacement."""
    per = ratings.filter(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").alias("n"))
    items = per.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq")).filter("r > 1")
    do = items.agg((F.sum(F.col("r") * F.col("r") - F.col("sq")) / F.sum(F.col("r") * (F.col("r") - 1))).alias("d"))
    total = per.groupBy(label).agg(F.sum("n").alias("n"))
    de = total.agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("e"))
    return do.crossJoin(de).select(F.round(F.when(F.col("e") == 0, 1.0).otherwise(1 - F.col("d") / F.col("e")), 4).alias("alpha"))  # one row each


def disagreements(ratings: DataFrame, item: str, label: str, least: int = 2) -> DataFrame:
    """Items on which annotators differ: 1 - 1 / number of different labels."""
    x = ratings.groupBy(item).agg(F.count("*").alias("annotators"), F.count_distinct(label).alias("labels"))
    return x.filter((F.col("annotators") >= least) & (F.col("labels") > 1)).withColumn("disagreement", F.round(1 - 1 / F.col("labels"), 4))
