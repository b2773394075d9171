"""Vectors that point nearly the same way: an exact join by cosine, and the checks between splits that rest on it.

Directions are dealt to the nearest of a bounded number of pivots, and each cell is cut into blocks of bounded size. A
block knows its mean direction and how far off its farthest vector is, so two blocks that are farther apart than the
threshold allows never meet (angles on a sphere obey the triangle inequality). Those that do are multiplied pair by
pair of blocks, each a group of two rows; no cell is gathered in one task, and a vector is held once but for that.

Vectors that are null, empty, of norm zero or hold null or non-finite entries have no direction and no partners.
Rows without a key take no part. Equal vectors of one side are a class, named by the least key; pairs are pairs of
classes, and classes() tells the members, so copies aren't spelled out in pairs. Vectors of different lengths don't
meet. A table without rows gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.shared import discard, written

#: Pivots at most (a bounded sample, chosen by hash), vectors of a block, and how many rows of one block meet another at once.
PIVOTS, BLOCK, _SLICE = 64, 8192, 512
#: Slack for rounding, so that a pair just at the threshold always meets; the threshold itself is then held exactly.
_SLACK = 1e-9


def sound(rows: DataFrame, key: str, vector: str, side: Column | None = None) -> DataFrame:
    """side, id, v (doubles), h1 and h2 (hashes of the vector) of the rows that have a direction."""
    x = rows.select((F.lit(0) if side is None else side.cast("int")).alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    x = x.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))  # one zero
    finite = F.forall("v", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False))) & F.exists("v", lambda c: c != 0)
    return x.filter("id is not null and v is not null").filter(finite).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def classes(rows: DataFrame, key: str, vector: str, side: Column | None = None) -> DataFrame:
    """side, id, class (the least id of the side's equal vectors) and copies (how many those are) of every row with a direction."""
    x = sound(rows, key, vector, side).select("side", "id", "h1", "h2")
    named = x.groupBy("side", "h1", "h2").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    return x.join(named, ["side", "h1", "h2"]).select("side", "id", "class", "copies")


def similar_vectors(rows: DataFrame, key: str, vector: str, threshold: float, side: Column | None = None, across: bool = False, pivots: int = PIVOTS, block: int = BLOCK, fresh: bool = False) -> DataFrame:
    """side_a, a, side_b, b, similarity: pairs of classes whose cosine is at least the threshold (over 0), (side_a, a) before (side_b, b); with `across`, of different sides only; with `fresh`, without pairs within side 0."""
    one = sound(rows, key, vector, side).groupBy("side", "h1", "h2").agg(F.min("id").alias("id"), F.first("v").alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda n, c: F.greatest(n, F.abs(c)))
    unit = F.transform("v", lambda c: c / size)  # first by the largest entry, so that no square overflows
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda n, c: n + c * c))
    one = written(one.withColumn("v", unit).withColumn("v", F.transform("v", lambda c: c / norm)).select("side", "id", "v", F.size("v").alias("d")))

    most = max(min(pivots, -(-one.count() // block)), 1)
    chosen = one.orderBy(F.xxhash64("id", "side"), "id", "side").limit(most).select("v").collect()
    by_length: dict[int, np.ndarray] = {}
    for d in {len(r["v"]) for r in chosen}:
        by_length[d] = np.array([r["v"] for r in chosen if len(r["v"]) == d])
    angle = math.acos(max(min(threshold, 1.0), 0.0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(3))
            for d in np.unique(lengths).tolist():
                part = b.take(pa.array(np.flatnonzero(lengths == d)))
                x = np.asarray(part.column(2).flatten()).reshape(part.num_rows, d)
                own = (x @ by_length.get(d, np.eye(1, d)).T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(3), pa.array(own), part.column(0), part.column(1), part.column(2)], ["d", "cell", "side", "id", "v"])

    dealt = written(one.mapInArrow(deal, "d int, cell long, side int, id long, v array<double>").withColumn("kind", F.col("side") if fresh else F.lit(0)))
    blocks = dealt.groupBy("d", "kind", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    cut = dealt.join(F.broadcast(blocks), ["d", "kind", "cell"])  # a row for each pivot and length of its vectors
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id", "side", F.lit(7)), "blocks")).select("d", "kind", "cell", "part", "side", "id", "v")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        d = group["d"][0].as_py()
        x = np.asarray(group["v"].combine_chunks().flatten()).reshape(-1, d)
        mean = x.sum(axis=0)
        length = np.sqrt(mean @ mean)
        mean = mean / length if length > 1e-6 else np.eye(1, d)[0]
        off = float(np.arccos(np.clip(x @ mean, -1, 1)).max())
        return pa.table([*(group[c].slice(0, 1) for c in ("d", "kind", "cell", "part")), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([off]), *(pa.array([np.ascontiguousarray(v).tobytes()]) for v in (np.asarray(group["side"], np.int32), np.asarray(group["id"], np.int64), x))], ["d", "kind", "cell", "part", "mean", "off", "sides", "ids", "vs"])

    packed = written(cut.groupBy("d", "kind", "cell", "part").applyInArrow(pack, "d int, kind int, cell long, part long, mean array<double>, off double, sides binary, ids binary, vs binary"))
    heads = packed.select("d", F.struct("kind", "cell", "part").alias("at"), "mean", "off")
    p, q = (heads.select("d", *(F.col(c).alias(f"{c}_{k}") for c in ("at", "mean", "off"))) for k in "ab")
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("mean_a", "mean_b", lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t))))
    pairs = p.join(q, "d").filter((F.col("at_a") <= F.col("at_b")) & (between <= F.col("off_a") + F.col("off_b") + angle + 1e-6))  # acos is off by more than the slack near 1
    if fresh:
        pairs = pairs.filter("at_a.kind = 1 or at_b.kind = 1")
    pairs = pairs.select("d", F.col("at_a").alias("first"), F.col("at_b").alias("second"), F.explode(F.when(F.col("at_a") == F.col("at_b"), F.array("at_a")).otherwise(F.array("at_a", "at_b"))).alias("at"))
    met = pairs.join(packed.select("d", F.struct("kind", "cell", "part").alias("at"), "sides", "ids", "vs"), ["d", "at"])

    def multiply(group: pa.Table) -> pa.Table:
        d = group["d"][0].as_py()
        found = {}
        for r in range(group.num_rows):
            found[group["at"][r] == group["first"][r]] = [np.frombuffer(group[c][r].as_buffer(), kind) for c, kind in (("sides", np.int32), ("ids", np.int64), ("vs", np.float64))]
        same = len(found) == 1
        side_a, id_a, x = found[True]
        side_b, id_b, y = found[same]
        x, y = x.reshape(-1, d), y.reshape(-1, d)
        out = []
        for start in range(0, len(x), _SLICE):
            scores = x[start : start + _SLICE] @ y.T
            r, s = np.nonzero(scores >= threshold - _SLACK)
            score, r = scores[r, s], r + start
            good = (r > s) if same else np.ones(len(r), bool)
            if across:
                good &= side_a[r] != side_b[s]
            if fresh:
                good &= (side_a[r] != 0) | (side_b[s] != 0)
            r, s, score = r[good], s[good], score[good]
            swap = (side_a[r] > side_b[s]) | (side_a[r] == side_b[s]) & (id_a[r] > id_b[s])
            out.append([np.where(swap, v[s], u[r]) for u, v in ((side_a, side_b), (id_a, id_b))] + [np.where(swap, u[r], v[s]) for u, v in ((side_a, side_b), (id_a, id_b))] + [score])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["side_a", "a", "side_b", "b", "similarity"])

    found = met.groupBy("d", "first", "second").applyInArrow(multiply, "side_a int, a long, side_b int, b long, similarity double")
    found = written(found.filter(F.col("similarity") >= threshold).withColumn("similarity", F.least(F.round("similarity", 6), F.lit(1.0))))
    discard(one, dealt, packed)
    return found


def linked(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """key, class_id, copies and n_links (other rows whose cosine is at least the threshold) of every row with a direction."""
    members = written(classes(rows, key, vector))
    pairs = similar_vectors(rows, key, vector, threshold)
    sizes = members.filter("id = class").select(F.col("class").alias("b"), "copies").distinct()
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = written(both.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others")))
    out = members.join(links, "class", "left")
    return out.select(F.col("id").alias(key), F.col("class").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def embedding_leakage(rows: DataFrame, key: str, vector: str, split: str, threshold: float = 0.95) -> DataFrame:
    """Vectors of train that other splits have nearly, between classes of a split: train_id, other, other_id, similarity, severity."""
    side = F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).when(F.col(split) == "test", 2)
    found = similar_vectors(rows.filter(side.isNotNull()), key, vector, threshold, side, across=True).filter("side_a = 0")
    return found.select(F.col("a").alias("train_id"), F.when(F.col("side_b") == 1, "val").otherwise("test").alias("other"), F.col("b").alias("other_id"), "similarity", F.when(F.col("similarity") > 0.99, "high").otherwise("medium").alias("severity"))
