"""Isolation forest: rows that random cuts part from the others early.

The trees grow on the driver, from a pool of TREES * SAMPLE rows at most that Spark draws by a hash, each tree from SAMPLE
of them, so what reaches the driver is bounded whatever the input. The forest, a few hundred kilobytes of arrays, goes to
the tasks, which follow every row through all trees at once. The limit is an exact percentile of all rows' scores.

Rows with a null or non-finite measure have no score and are no anomaly. Equal rows get equal scores; rows of one key
and equal measures are drawn together, as far as the pool has room. With fewer than two different rows every score is a half and none an anomaly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators import quantiles
from loomset.operators.shared import written

#: Trees, and rows that each grows from; both bound what the driver holds.
TREES, SAMPLE = 100, 256


def expected_depth(n: np.ndarray) -> np.ndarray:
    """The mean depth of a search that fails in a binary tree of n rows."""
    n = np.asarray(n, float)
    more = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))


def grown(x: np.ndarray, rng: np.random.Generator, deepest: int) -> list[tuple[int, float, int, int, float]]:
    """A tree as nodes (measure or -1, cut, left, right, length of the way that ends here)."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= deepest or not len(wide):
            nodes[at] = (-1, 0.0, at, at, depth + float(expected_depth(np.array(len(rows)))))
            return at
        k = int(rng.choice(wide))
        cut = float(rng.uniform(low[k], high[k]))
        left = rows[:, k] <= cut
        if left.all():  # a cut at the upper end parts nothing
            left = rows[:, k] < high[k]
            cut = float(rows[left, k].max())
        a = grow(rows[left], depth + 1)
        nodes[at] = (k, cut, a, grow(rows[~left], depth + 1), 0.0)
        return at

    grow(x, 0)
    return nodes


def scores_of(x: np.ndarray, forest: list[tuple[np.ndarray, ...]], sample: int) -> np.ndarray:
    """The anomaly score, near 1 for rows parted early and under a half for common ones."""
    total = np.zeros(len(x))
    for measure, cut, left, right, length in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            k = measure[at]
            inner = np.flatnonzero(k >= 0)
            if not len(inner):
                break
            go = x[inner, k[inner]] <= cut[at[inner]]
            at[inner] = np.where(go, left[at[inner]], right[at[inner]])
        total += length[at]
    return 2.0 ** (-total / len(forest) / float(expected_depth(np.array(sample))))


def forest_anomalies(rows: DataFrame, key: str, measures: list[str], share: float = 0.1, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """key, score (0 to 1, higher: sooner apart) and anomaly of each row: whether its score is over the percentile that leaves about `share` of the rows."""
    x = rows.select(F.col(key).alias("key"), F.array(*(F.col(m).cast("double") for m in measures)).alias("x"))
    x = x.withColumn("sound", F.forall("x", lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False))))
    n, pool = x.filter("sound").count(), trees * sample
    place = F.xxhash64("key", "x", F.lit(seed))
    near = F.shiftrightunsigned(place, 11) < int(min(1.0, 1.5 * pool / max(n, 1) + 1e-6) * (1 << 53))  # some more than are needed, so that few are sorted
    drawn = np.array([r["x"] for r in x.filter("sound").filter(near).orderBy(F.shiftrightunsigned(place, 11), "x").limit(pool).select("x").collect()]).reshape(-1, len(measures))
    rng, size = np.random.default_rng(seed), min(sample, len(drawn))
    forest = []
    if size > 1 and (drawn != drawn[0]).any():
        for _ in range(trees):
            tree = grown(drawn[rng.choice(len(drawn), size, replace=False)], rng, math.ceil(math.log2(size)))
            forest.append(tuple(np.array(c) for c in zip(*tree, strict=True)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sound = b.column(2).to_numpy(zero_copy_only=False)
            out = np.full(b.num_rows, np.nan)
            values = np.asarray(b.column(1).filter(b.column(2)).flatten(), float).reshape(-1, len(measures))
            out[sound] = scores_of(values, forest, size) if forest else 0.5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, from_pandas=True)], ["key", "score"])

    scored = written(x.mapInArrow(score, f"key {x.schema['key'].dataType.simpleString()}, score double").withColumn("score", F.round("score", 9)))
    limit = quantiles.percentiles(scored.filter("score is not null").select(F.lit("all").alias("g"), F.col("score").alias("v")), {"most": 1 - share})
    most = limit.select("most").first()
    high = F.coalesce(F.col("score") > most["most"], F.lit(False)) if most and forest else F.lit(False)
    return scored.select(F.col("key").alias(key), "score", high.alias("anomaly"))
