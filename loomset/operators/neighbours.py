"""The k nearest neighbours of points, exactly, by cells whose size follows the crowd; normals and outliers from them.

1. Points of one place are one row that keeps the k + 1 least ids: no neighbour list has room for more.
2. Cells halve from the cloud's box down, LEVELS times at most. A place is looked at in the smallest of its cells that
   holds more than k points. The k-th distance within that cell bounds the true one, so only cells of that size that
   meet the ball of that radius can hold nearer points. Few places share a large cell's level, since the crowded
   parts of it have smaller cells of their own, so a crowd isn't compared with itself in pairs.
3. A cell's points are lists of BLOCK at most; a place meets a list whole and keeps the k + 1 nearest of it within the
   bound, by distance and then id, so pairs of points are never rows that a task sorts. Spark puts a place's lists together.

Rows with a null id or coordinate, or one that isn't finite, take no part; a null cloud is a cloud like others. In a
cloud of k points or fewer each point's neighbours are all others. Repeated rows (of one id) are neighbours of each
other, listed as often as they come. Distinct places nearer to each other than 2 ** -LEVELS of the box share a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.operators.shared import discard, written

LEVELS, BLOCK = 16, 64
_AXES = ("x", "y", "z")


def nearest_points(points: DataFrame, cloud: str, key: str, k: int = 10) -> DataFrame:
    """cloud, key, x, y, z and near: structs (away, id, x, y, z) of the k nearest other points of the cloud, by distance and then id."""
    p = points.select(F.col(cloud).alias("c"), F.col(key).cast("long").alias("id"), *((F.col(a).cast("double") + F.lit(0.0)).alias(a) for a in _AXES))
    sound = F.col("id").isNotNull()
    for a in _AXES:
        sound &= F.coalesce((F.col(a) > float("-inf")) & (F.col(a) < float("inf")), F.lit(False))
    p = p.filter(sound)
    ranked = p.withColumn("k", F.row_number().over(Window.partitionBy("c", *_AXES).orderBy("id"))).filter(F.col("k") <= k + 1)
    places = ranked.groupBy("c", *_AXES).agg(F.sort_array(F.collect_list("id")).alias("ids"))

    box = p.groupBy("c").agg(*(F.min(a).alias(f"{a}0") for a in _AXES), F.greatest(*(F.max(a) - F.min(a) for a in _AXES)).alias("side"))
    placed = written(places.join(box, places["c"].eqNullSafe(box["c"])).select(places["c"], *_AXES, "ids", *(f"{a}0" for a in _AXES), "side").withColumn("place", F.monotonically_increasing_id()))

    def cell(a: str, at=None):
        """The cell's number along an axis, at a level; the box's far border belongs to the last cell."""
        return F.when(F.col("side") > 0, F.floor(((F.col(a) if at is None else at) - F.col(f"{a}0")) / F.col("side") * F.pow(F.lit(2.0), "level"))).otherwise(0).cast("long")

    def in_cells(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"i{a}": F.least(cell(a), F.pow(F.lit(2.0), "level").cast("long") - 1) for a in _AXES})

    ids = ["c", "level", *(f"i{a}" for a in _AXES)]
    each = in_cells(placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))))
    crowd = each.groupBy(*ids).agg(F.sum(F.size("ids")).alias("points")).filter(F.col("points") > k)
    same = F.lit(True)
    fine, full = each.select("place", *ids), crowd.select(*(F.col(x).alias(f"r_{x}") for x in ids))
    for x in ids:
        same &= F.col(x).eqNullSafe(F.col(f"r_{x}"))
    level = written(fine.join(full, same, "leftsemi").groupBy("place").agg(F.max("level").alias("level")))
    asked = written(placed.join(level, "place", "left").withColumn("level", F.coalesce("level", F.lit(0))))
    used = [r["level"] for r in asked.select("level").distinct().collect()]  # LEVELS + 1 at most
    known = in_cells(placed.withColumn("level", F.explode(F.lit(used or [0])))).select(*(F.col(x).alias(f"r_{x}") for x in ids), F.struct(*_AXES, "ids").alias("point"), "place")
    nth = F.row_number().over(Window.partitionBy(*(f"r_{x}" for x in ids)).orderBy("place"))
    known = known.withColumn("block", F.floor((nth - 1) / BLOCK)).groupBy(*(f"r_{x}" for x in ids), "block").agg(F.collect_list("point").alias("points"))
    known = written(known)

    def away(p):
        return F.sqrt(sum(((p[a] - F.col(a)) * (p[a] - F.col(a)) for a in _AXES[1:]), (p["x"] - F.col("x")) * (p["x"] - F.col("x"))))

    def nearest(rows: DataFrame, each) -> DataFrame:
        """place and near of each place and block of the given cells: the k + 1 first of what each point of the block gives."""
        return rows.join(known, same).select("place", F.slice(F.sort_array(F.flatten(each(F.col("points")))), 1, k + 1).alias("near")).filter(F.size("near") > 0)

    def distances(points):
        return F.transform(points, lambda p: F.array_repeat(away(p), F.size(p["ids"])))

    def within(points):
        """away, id and coordinates of the points within the radius, of all without one."""
        inside = F.filter(points, lambda p: F.col("radius").isNull() | (away(p) <= F.col("radius")))
        return F.transform(inside, lambda p: F.transform(p["ids"], lambda i: F.struct(away(p).alias("away"), i.alias("id"), *(p[a].alias(a) for a in _AXES))))

    def first(near):
        """The k + 1 first of a place's lists."""
        return F.slice(F.sort_array(F.flatten(F.collect_list(near))), 1, k + 1)

    # the bound: the k-th distance to other points within the place's own cell (without it, the box is that cell)
    own = nearest(in_cells(asked), distances)
    bound = own.groupBy("place").agg(first("near").alias("near")).filter(F.size("near") == k + 1).select("place", F.get("near", F.lit(k)).alias("radius"))
    bounded = asked.join(written(bound), "place", "left")
    last = F.pow(F.lit(2.0), "level").cast("long") - 1
    wide = bounded
    for a in _AXES:
        slack = F.col("radius") * 1.000001 + F.abs(F.col(a)) * 1e-12
        low, high = (F.when(F.col("radius").isNull(), F.lit(edge)).otherwise(F.least(F.greatest(cell(a, F.col(a) + sign * slack), F.lit(0)), last)) for sign, edge in ((-1, 0), (1, 0)))
        wide = wide.withColumn(f"i{a}", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    found = nearest(wide, within).groupBy("place").agg(first("near").alias("near"))
    lists = written(placed.select("place", *(F.col(x).alias(f"p_{x}") for x in ("c", *_AXES))).join(found, "place"))

    here = p["c"].eqNullSafe(lists["p_c"])
    for a in _AXES:
        here &= p[a] == lists[f"p_{a}"]
    own = F.array_position(F.transform("near", lambda n: n["id"]), F.col("id"))
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), F.greatest(own - 1, F.lit(0)).cast("int")), F.slice("near", (own + 1).cast("int"), F.lit(k + 1)))).otherwise(F.col("near"))
    out = p.join(lists, here).select(F.col("c").alias(cloud), F.col("id").alias(key), *_AXES, F.slice(others, 1, k).alias("near"))
    discard(level, asked, known)
    return out


def point_normals(points: DataFrame, cloud: str, key: str, k: int = 10) -> DataFrame:
    """cloud, key, nx, ny, nz: the unit cross product of the ways to the two nearest points, (0, 0, 1) where that is zero; none for clouds of fewer than k points."""
    near = nearest_points(points, cloud, key, k).filter(F.size("near") >= k - 1)
    a, b = ([F.col("near")[i][axis] - F.col(axis) for axis in _AXES] for i in (0, 1))
    v = [F.coalesce(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3], F.lit(0.0)) for i in range(3)]
    x = near.select(cloud, key, *(c.alias(f"v{axis}") for c, axis in zip(v, _AXES, strict=True)))
    size = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    return x.select(cloud, key, *(F.when(size > 0, F.round(F.col(f"v{axis}") / size, 5)).otherwise(F.lit(float(axis == "z"))).alias(f"n{axis}") for axis in _AXES))


def point_outliers(points: DataFrame, cloud: str, key: str, k: int = 10, ratio: float = 2.0) -> DataFrame:
    """cloud, key, mean_distance to the k nearest (their sum over k) and outlier: over the cloud's mean by more than `ratio` standard deviations; clouds of fewer than k points have none."""
    near = nearest_points(points, cloud, key, k)
    x = near.select(cloud, key, F.size("near").alias("n"), (F.aggregate("near", F.lit(0.0), lambda s, n: s + n["away"]) / k).alias("mean"))
    x = written(x)
    limit = x.groupBy(F.col(cloud).alias("of")).agg((F.avg("mean") + ratio * F.stddev_pop("mean")).alias("most"))
    out = x.join(limit, x[cloud].eqNullSafe(limit["of"]))
    return out.select(cloud, key, F.round("mean", 6).alias("mean_distance"), ((F.col("n") >= k - 1) & (F.col("mean") > F.col("most"))).alias("outlier"))
