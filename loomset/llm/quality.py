"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Statistics of each whole text come from one vectorised pass. Shallow trees, grown on random rows and statistics of
a bounded sample of labelled rows, give conjunctive rules (the paths to their nodes); a logistic regression with a
lasso penalty weighs the rules and drops most. What is left is a sum of CASE expressions over the statistics.

Null and empty texts have the statistics of a text without bytes, 0, and get a score like any other. Labels that
are null, and labelled rows without a document, teach nothing; with labels of one kind or none, every score is
their smoothed mean. Rows are scored one by one: repeated rows get the same score, a null doc_id is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomset.llm.common import prefix_hashes, slices, span_hashes, text_buffers, words

#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, LEAF, PENALTY, STEPS = 24, 3, 32, 20, 0.003, 400
#: A document is kept from this score on.
THRESHOLD = 0.3

STATISTICS = ("n_bytes", "n_words", "word_bytes", "distinct_words", "repeated_next", "upper", "digits", "symbols", "stops", "spaces", "not_ascii", "lines", "distinct_lines")

_STOPS, _LINE = b".,;:'\"-()", 10
_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 65:91] = True  # upper
_CLASSES[1, 48:58] = True  # digits
_CLASSES[2, [c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS]] = True  # symbols
_CLASSES[3, list(_STOPS)] = True
_CLASSES[4, [32, *range(9, 14)]] = True  # spaces
_CLASSES[5, 128:] = True


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many different values each row has."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(r[new], minlength=len(rows) - 1)


def statistics_of(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text in data (offs from 0)."""
    n = np.diff(offs).astype(float)
    hashes, start, end, rows = words(data, offs)
    count = np.diff(rows).astype(float)
    some_words, some_bytes = np.maximum(count, 1), np.maximum(n, 1)

    def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags)][at]).astype(float)

    shares = [per_row(c[data], offs) / some_bytes for c in _CLASSES]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[rows[:-1][rows[:-1] < len(same)]] = False
    # lines: a break ends one, and so does the end of the text
    breaks = np.flatnonzero(data == _LINE)
    begin = np.union1d(offs[:-1][n > 0], breaks + 1)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))[: len(begin)]
    line_rows = np.searchsorted(begin, offs)
    line = span_hashes(prefix_hashes(data), begin, stop - (data[stop - 1] == _LINE))
    lines = np.diff(line_rows).astype(float)
    return np.column_stack([
        n, count, per_row_sum(end - start, rows) / some_words, _distinct(hashes, rows) / some_words, per_row(same, rows) / some_words,
        *shares[:4], shares[4], shares[5], lines / some_words, _distinct(line, line_rows) / np.maximum(lines, 1),
    ])


def per_row_sum(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][rows]).astype(float)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows' other columns and the statistics of their texts, in place of the text."""
    kept = [c for c in df.columns if c != text_col]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(f"__{c}", DoubleType()) for c in STATISTICS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffers(b.column(b.num_columns - 1))
            parts = [statistics_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1]))], [*kept, *(f"__{c}" for c in STATISTICS)])

    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__text")).mapInArrow(scan, schema)


#: A condition: statistic, whether it must be larger, threshold.
Condition = tuple[int, bool, float]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1, as a column over the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = None
            for k, larger, at in conditions:
                c = F.col(f"__{STATISTICS[k]}")
                one = c > at if larger else c <= at
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, path: tuple, depth: int, rng: np.random.Generator, out: set) -> None:
    """Splits on Gini impurity over binned statistics; each node's path goes to out."""
    if path:
        out.add(path)
    if depth == 0 or len(rows) < 2 * LEAF or not 0 < y[rows].sum() < len(rows):
        return
    best = (1e-9, 0, 0)
    whole = y[rows].mean()
    for k in rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False):
        size = len(edges[k]) + 1
        n = np.bincount(x[rows, k], minlength=size)
        ones = np.bincount(x[rows, k], y[rows], minlength=size)
        left, good = np.cumsum(n)[:-1], np.cumsum(ones)[:-1]
        right, rest = len(rows) - left, y[rows].sum() - good
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = good / left, rest / right
            gain = whole * (1 - whole) - (left * p * (1 - p) + right * q * (1 - q)) / len(rows)
        gain[(left < LEAF) | (right < LEAF)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), k, int(gain.argmax()))
    if best[0] <= 1e-9:
        return
    _, k, cut = best
    low = x[rows, k] <= cut
    for side, larger in ((rows[low], False), (rows[~low], True)):
        _grow(x, y, edges, side, (*path, (int(k), larger, float(edges[k][cut]))), depth - 1, rng, out)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute penalty on all but the intercept, by accelerated proximal steps."""
    n, m = r.shape
    step = 4 / (np.linalg.norm(np.column_stack([np.ones(n), r]), 2) ** 2 / n)
    w = v = np.zeros(m)
    b = c = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(c + r @ v))) - y
        b2, w2 = c - step * error.mean(), v - step * (r.T @ error) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> RuleModel:
    """Rules and weights from a matrix of statistics and labels 0 and 1."""
    mean = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 2 * LEAF or not 0 < y.sum() < len(y):
        return RuleModel(float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    paths: set = set()
    for _ in range(TREES):
        _grow(binned, y, edges, rng.choice(len(y), max(2 * LEAF, len(y) // 2), replace=False), (), DEPTH, rng, paths)
    rules = sorted(paths)
    held = np.column_stack([np.logical_and.reduce([(x[:, k] > at) == larger for k, larger, at in p]) for p in rules]) if rules else np.zeros((len(y), 0), bool)
    _, first = np.unique(np.packbits(held, axis=0), axis=1, return_index=True)
    first = [k for k in sorted(first) if held[:, k].any() and not held[:, k].all()]
    if not first:
        return RuleModel(float(np.log(mean / (1 - mean))))
    b, w = _lasso(held[:, first].astype(float), y.astype(float), PENALTY)
    return RuleModel(float(b), [(rules[k], float(v)) for k, v in zip(first, w, strict=True) if abs(v) > 1e-6])


def fold(id_col: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out of training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS) -> RuleModel:
    """A model of labels.quality from at most so many labelled documents outside the held-out fold.

    The sample is a broadcast of two columns whose size its bound proves; the bound holds for the rows that reach the
    driver too (numbers, no texts), however often a doc_id repeats.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).filter((fold("__id") != 0) & F.col("__label").isin(0, 1))
    chosen = known.orderBy(F.xxhash64("__id"), "__label").limit(most)
    taught = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("text")).join(F.broadcast(chosen), "__id").select("__label", "text")
    numbers = with_statistics(taught)
    got = np.array(numbers.orderBy(F.xxhash64(*numbers.columns), *numbers.columns).limit(most).toPandas(), float).reshape(-1, len(STATISTICS) + 1)
    got = got[np.lexsort(got.T[::-1])]  # so that the order of arrival doesn't matter
    return fit_rules(got[:, 1:], got[:, 0])


def scored(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    x = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = x.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def kept(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model doesn't reject, all their columns as they were."""
    whole = docs.select(F.struct("*").alias("row"), "text")  # in a struct no column's name can clash
    return with_statistics(whole).filter(model.score() >= threshold).select("row.*")
