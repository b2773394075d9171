"""Point clouds as rows (cloud, x, y, z), and boxes around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cloud_stats(points: DataFrame, cloud: str) -> DataFrame:
    """Bounds, centroid, volume (an extent of 0 counts as 1), density and distances from the centroid."""
    axes = [f for a in "xyz" for f in (F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.avg(a).alias(f"c{a}"))]
    b = points.groupBy(cloud).agg(F.count("*").alias("n"), *axes)
    away = F.sqrt(sum((F.pow(F.col(a) - F.col(f"c{a}"), 2) for a in "xyz"), F.lit(0.0)))
    far = points.join(b, cloud).groupBy(cloud).agg(F.avg(away).alias("mean_distance"), F.max(away).alias("max_distance"))
    volume = F.lit(1.0)
    for a in "xyz":
        e = F.col(f"max_{a}") - F.col(f"min_{a}")
        volume = volume * F.when(e == 0, 1.0).otherwise(e)
    x = b.join(far, cloud).withColumn("volume", volume)
    return x.select(cloud, "n", *(F.round(f"c{a}", 5).alias(f"c{a}") for a in "xyz"), F.round("volume", 5).alias("volume"), F.round(F.col("n") / F.col("volume"), 4).alias("density"), F.round("mean_distance", 5).alias("mean_distance"), F.round("max_distance", 5).alias("max_distance"))


def voxels(points: DataFrame, cloud: str, size: float = 0.1) -> DataFrame:
    """One mean point for each cell of a grid; cells are cut toward zero."""
    cell = [F.expr(f"cast(cast({a} as double) / {size} as bigint)").alias(f"v{a}") for a in "xyz"]
    return points.groupBy(cloud, *cell).agg(F.count("*").alias("n"), *(F.round(F.avg(a), 5).alias(a) for a in "xyz"))


def ground(points: DataFrame, cloud: str, threshold: float = 0.1) -> DataFrame:
    """Points within the threshold of the lowest: how many, their mean height and share."""
    low = points.groupBy(cloud).agg(F.min("z").alias("low"), F.count("*").alias("n"))
    x = points.join(low, cloud).filter(F.col("z") < F.col("low") + threshold)
    return x.groupBy(cloud).agg(F.count("*").alias("points"), F.round(F.avg("z"), 5).alias("height"), F.round(100 * F.count("*") / F.first("n"), 4).alias("percent"))


def height_segments(points: DataFrame, cloud: str, segments: int = 5) -> DataFrame:
    """Points in equal half-open bins of height; the highest point is in none."""
    b = points.groupBy(cloud).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    k = F.floor((F.col("z") - F.col("low")) / ((F.col("high") - F.col("low")) / segments))
    x = points.join(b, cloud).filter("high > low and z < high").withColumn("segment", F.least(k, F.lit(segments - 1)))
    return x.groupBy(cloud, "segment").agg(F.count("*").alias("n"))


def box_corners(boxes: DataFrame, key: str) -> DataFrame:
    """The eight corners of boxes (cx, cy, cz, length, width, height) turned about the vertical axis, their distance from the centre and the volume."""
    sign = F.array(F.lit(-1), F.lit(1))
    x = boxes.withColumn("sx", F.explode(sign)).withColumn("sy", F.explode(sign)).withColumn("sz", F.explode(sign))
    l, w, h = (F.col(s) * F.col(e) / 2 for s, e in (("sx", "length"), ("sy", "width"), ("sz", "height")))
    cos, sin = F.cos("turn"), F.sin("turn")
    return x.select(
        key, F.round(F.col("cx") + l * cos - w * sin, 6).alias("x"), F.round(F.col("cy") + l * sin + w * cos, 6).alias("y"), F.round(F.col("cz") + h, 6).alias("z"),
        F.round(F.col("length") * F.col("width") * F.col("height"), 6).alias("volume"), F.round(F.sqrt(l * l + w * w + h * h), 6).alias("distance"),
    )
