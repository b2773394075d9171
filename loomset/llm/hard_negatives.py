"""Hard negatives by norm-bucketed search: exact best inner products within limits, for stated anchors, against all rows.

1. Rows are sorted by falling norm and cut into buckets (ranges of norm, MOST_BUCKETS at most), which are packed in
   blocks of bounded size.
2. A search goes through the buckets in a few rounds, each of eight times as many as the one before. By Cauchy and
   Schwarz no row of a bucket scores more than the anchor's norm times the bucket's largest. An anchor skips a
   bucket whose bound is below the lower limits of all its windows, or below the k-th best score that it has found
   so far for each. A bound that equals the k-th score is searched, for a tie with a smaller id may be there.
3. Anchors travel in packed chunks to the blocks that they need; a task multiplies a chunk by a block, sorts each
   anchor's scores once and reads off every window's best. Spark keeps the best k of each window, in part before it
   shuffles. Nothing but the buckets' sizes and norms (a row for each) reaches the driver.

The positives are such a search for rows of the anchor's label without limits, the negatives one for rows of other
labels with a window for each positive.

Scores are exact whole numbers (beyond 2 ** 53 by unbounded integers; one beyond a long is returned as the nearest
long). Rows take no part without an id, a label or a vector, or with a null or non-finite entry. Shorter vectors are
read as ending in zeros. Each row counts by itself, repeated ones too, but rows of the anchor's own id are never its
partners. Ties go to the smaller id. Tables without rows or anchors give no rows. Columns other than the three named
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import discard, written
from loomset.llm.embeddings import SCALE, matrix, padded, whole

#: Rows of a block and anchors of a chunk, at most; bytes of a block's vectors; ranges of norm.
BLOCK, CHUNK, BLOCK_BYTES, MOST_BUCKETS = 4096, 256, 4 << 20, 1024
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Slack for the rounding of norms.
_MORE = 1 + 1e-9

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")))


def packed(rows: DataFrame, width: int, most: int = BLOCK) -> DataFrame:
    """bucket, block, norm (the largest), ids, labels and vectors (bytes of longs) of the rows vec_id, label, x, norm, by falling norm."""
    most = max(1, min(most, BLOCK_BYTES // (8 * max(1, width))))
    parts = min(MOST_BUCKETS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("norm").desc(), F.col("vec_id")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(table: pa.Table) -> pa.RecordBatch:
            ids, labels = (np.asarray(table.column(k), np.int64) for k in (0, 1))
            x = matrix(table.column(2).combine_chunks(), width)
            norm = float(np.asarray(table.column(3)).max())
            return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([block], pa.int32()), pa.array([norm])] + [pa.array([a.tobytes()], pa.binary()) for a in (ids, labels, x)], ["bucket", "block", "norm", "ids", "labels", "vectors"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= most:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, most))
                block, n, held = block + 1, n - most, table.slice(most).to_batches()
        if n:
            yield out(pa.Table.from_batches(held))

    ordered = rows.select("vec_id", "label", "x", "norm").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return written(ordered.mapInArrow(pack, "bucket long, block int, norm double, ids binary, labels binary, vectors binary"))


def chunked(anchors: DataFrame, width: int, most: int = CHUNK) -> DataFrame:
    """Anchors in packed chunks, neighbours with the same reach: last (buckets to search), norm, low (least limit), rows, ids, labels, vectors, and the windows' limits.

    anchors: row, vec_id, label, x, norm, last, and lows and highs, an array each with a limit for every window.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, most):
                c = b.slice(i, most)
                longs = [np.asarray(c.column(k), np.int64) for k in range(3)] + [np.asarray(c.column(k).flatten(), np.int64) for k in (3, 6, 7)]
                last = int(np.asarray(c.column(5)).max())
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.asarray(c.column(4), np.float64).tobytes()], pa.binary())] + [pa.array([a.tobytes()], pa.binary()) for a in longs], ["last", "norms", "rows", "a_ids", "a_labels", "a_vectors", "lows", "highs"])

    ordered = anchors.filter("last > 0").select("row", "vec_id", "label", "x", "norm", "last", "lows", "highs").sortWithinPartitions("last")
    return ordered.mapInArrow(pack, "last int, norms binary, rows binary, a_ids binary, a_labels binary, a_vectors binary, lows binary, highs binary")


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors: doubles where they are exact, else unbounded integers."""
    size = [np.sqrt(float((v.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for v in (a, b)]
    if size[0] * size[1] < 1 << 52:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def best(chunk: dict, block: dict, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Up to k best rows of a block for each window of a chunk's anchors: row, slot, score, vec_id."""
    alive = np.flatnonzero(chunk["norms"] * block["norm"] * _MORE >= chunk["lows"].min(axis=1))
    order = np.argsort(block["ids"], kind="stable")  # so that ties go to smaller ids
    ids, labels = block["ids"][order], block["labels"][order]
    scores = scores_of(chunk["x"][alive], block["x"][order])
    allowed = ((chunk["labels"][alive][:, None] == labels) == same) & (chunk["ids"][alive][:, None] != ids)
    scores = np.where(allowed, scores, -np.inf)
    down = np.argsort(-scores, axis=1, kind="stable")
    scores = np.take_along_axis(scores, down, axis=1)
    found = []
    for slot in range(chunk["lows"].shape[1]):
        low, high = chunk["lows"][alive, slot], chunk["highs"][alive, slot]
        if scores.dtype != object:  # limits beyond the scores' exact range are no limits
            low, high = low.astype(np.float64), high.astype(np.float64)
        at = (scores > high[:, None]).sum(axis=1)[:, None] + np.arange(k)
        got = np.take_along_axis(scores, np.minimum(at, len(ids) - 1), axis=1)
        i, j = np.nonzero((at < len(ids)) & (got >= low[:, None]) & (got > -np.inf))
        exact = got[i, j].astype(object) if scores.dtype == object else got[i, j]
        found.append((chunk["rows"][alive[i]], np.full(len(i), slot, np.int32), np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in exact], np.int64) if scores.dtype == object else exact.astype(np.int64), ids[down[i, at[i, j]]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _of(batch: pa.RecordBatch, i: int, width: int) -> tuple[dict, dict]:
    """A chunk and a block of a joined row."""
    get = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
    longs = {name: np.frombuffer(get[name], np.int64) for name in ("rows", "a_ids", "a_labels", "a_vectors", "lows", "highs", "ids", "labels", "vectors")}
    n = len(longs["rows"])
    chunk = {"norms": np.frombuffer(get["norms"], np.float64), "rows": longs["rows"], "ids": longs["a_ids"], "labels": longs["a_labels"], "x": longs["a_vectors"].reshape(n, width), "lows": longs["lows"].reshape(n, -1), "highs": longs["highs"].reshape(n, -1)}
    return chunk, {"norm": get["norm"], "ids": longs["ids"], "labels": longs["labels"], "x": longs["vectors"].reshape(len(longs["ids"]), width)}


def search(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, slots: int, k: int, same: bool, width: int, chunk: int = CHUNK) -> DataFrame:
    """The k best rows of every window: row, slot, score, vec_id, rank.

    blocks: from packed(). anchors: row (a number of its own), vec_id, label, x, norm. windows: row, slot (below
    `slots`), low and high, the least and the greatest score that count. same: rows of the anchor's label, else of
    the other labels.
    """
    buckets = blocks.groupBy("bucket").agg(F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("bucket").collect()
    ranked = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
    state, done, size = None, 0, 1
    while done < len(buckets):
        turn = buckets[done : done + size]
        limits = windows
        if state is not None:
            full = state.filter(F.col("rank") == k).select("row", "slot", F.col("score").alias("kth"))
            limits = windows.join(full, ["row", "slot"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
        of_row = limits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "high")))).alias("w"))
        lows, highs = (F.array(*[F.coalesce(F.col("w")[F.lit(s)][e], F.lit(none)) for s in range(slots)]) for e, none in (("low", _LONG[1]), ("high", _LONG[0])))
        ready = anchors.join(of_row, "row").withColumns({"lows": lows, "highs": highs})
        # norms fall from bucket to bucket, so the buckets to search are the first ones of the turn
        reach = F.size(F.filter(F.lit([b["norm"] for b in turn]), lambda top: top * F.col("norm") * _MORE >= F.array_min("lows")))
        chunks = chunked(ready.withColumn("last", reach), width, chunk)
        at = chunks.select("*", F.explode(F.sequence(F.lit(1), "last")).alias("at"))
        at = at.withColumns({"bucket": F.element_at(F.lit([b["bucket"] for b in turn]), F.col("at")), "block": F.explode(F.sequence(F.lit(0), F.element_at(F.lit([b["n"] for b in turn]), F.col("at")).cast("int") - 1))})
        joined = at.drop("last", "at").join(blocks, ["bucket", "block"])

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(*_of(b, i, width), k, same)], ["row", "slot", "score", "vec_id"])

        found = joined.mapInArrow(multiply, "row long, slot int, score long, vec_id long")
        every = found if state is None else found.unionByName(state.drop("rank"))
        newer = written(every.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k))
        if state is not None:
            discard(state)
        state, done, size = newer, done + len(turn), 8 * size
    return state


def unpacked(blocks: DataFrame, chosen: Column, width: int) -> DataFrame:
    """row (a number of its own), vec_id, label, x and norm of the chosen rows of packed blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                bucket, block = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids, labels, x = (np.frombuffer(b.column(k)[i].as_py(), np.int64) for k in (2, 3, 4))
                row = (bucket << 44) + block * BLOCK + np.arange(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids), pa.array(labels), lists], ["row", "vec_id", "label", "x"])

    rows = blocks.select("bucket", "block", "ids", "labels", "vectors").mapInArrow(unpack, "row long, vec_id long, label long, x array<long>")
    return rows.filter(chosen).withColumn("norm", _norm(F.col("x")))


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """For each anchor (an id divisible by `every`) and each of its best `positives` rows of the same label, the best `negatives` of other labels
    with least * positive_score <= 100 * negative_score <= most * positive_score: anchor_id, positive_id, rank, negative_id and both scores.
    """
    spark = rows.sparkSession
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole(F.col(vec_col), scale).alias("x")).filter("vec_id is not null and label is not null and x is not null")
    source, width = padded(source)
    blocks = packed(source.withColumn("norm", _norm(F.col("x"))), width, min(block, BLOCK))
    anchors = written(unpacked(blocks, F.col("vec_id") % every == 0, width))
    if anchors.isEmpty():
        discard(blocks, anchors)
        return spark.createDataFrame([], SCHEMA)
    free = anchors.select("row", F.lit(0).alias("slot"), F.lit(_LONG[0]).alias("low"), F.lit(_LONG[1]).alias("high"))
    near = search(blocks, anchors, free, 1, positives, True, width, chunk)
    parts = [F.col("score").cast("decimal(20,0)") * share for share in (least, most)]
    windows = near.select(
        "row",
        (F.col("rank") - 1).cast("int").alias("slot"),
        ((parts[0] + F.pmod(-parts[0], F.lit(100))) / 100).cast("long").alias("low"),  # rounded up
        ((parts[1] - F.pmod(parts[1], F.lit(100))) / 100).cast("long").alias("high"),  # rounded down
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    windows = written(windows.filter("low <= high"))
    hard = search(blocks, anchors, windows.select("row", "slot", "low", "high"), positives, negatives, False, width, chunk)
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    out = hard.join(windows.select("row", "slot", "positive_id", "positive_score"), ["row", "slot"]).join(ids, "row")
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    discard(blocks, anchors, near, windows, hard)
    return out
