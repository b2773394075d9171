"""Windows of 13 words that an earlier document has too, found by super-k-mer partitioning.

Consecutive windows that share a minimiser (the run of words in them with the least hash) make one packed string.
Equal windows have equal minimisers, so a minimiser's bucket holds every occurrence of each of its windows.

1. Every run is sent to its minimiser's bucket as two hashes and a place; buckets with one document end there.
   The sums behind that are pre-aggregated and written before they are joined back, so Spark can split the
   partition of a hot minimiser; no step needs a bucket's rows together.
2. Where a bucket has several different strings, one copy of each travels there, packed, with the smallest
   doc_id that has it. Sorting the windows of all of them gives each window's smallest doc_id. Buckets of more
   than `most` strings, or `most_windows` windows, are taken apart into windows, which Spark groups, so a task
   never holds one whole.
3. Each run learns its windows' smallest documents from its string; words of windows known from a smaller
   doc_id are removed.

Null and empty texts have no words. Rows with a null doc_id neither lose words nor cause any to be lost. Rows
with the same doc_id don't take words from each other, so repeated rows get the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import discard, int64s, keyed, minimiser_runs, prefix_hashes, prefix_of, same_row, slices, span_hashes, text_buffers, windows, words, written

WINDOW, GRAM = 13, 3
#: Packed bytes that a group of buckets has on average; strings of one minimiser, and their windows, that are sorted in one task.
BUCKET_BYTES, MOST_STRINGS, MOST_WINDOWS = 4_000_000, 30_000, 1_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """h (minimiser), g (string), doc_id, t1, t2, start (word), n (windows) of every run in the rows of keyed()."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffers(b.column(1))
            for i, j in slices(offs):
                o = offs[i : j + 1] - offs[i]
                hashes, *_, rows = words(data[offs[i] : offs[j]], o)
                grams = windows(hashes, gram)
                first, n, place, _ = minimiser_runs(grams, rows, window, gram)
                if not len(first):
                    continue
                row = np.searchsorted(rows, first, "right") - 1
                string = span_hashes(prefix_of(hashes), first, first + n + (window - 1))
                yield pa.RecordBatch.from_arrays(
                    [int64s(grams[place]), int64s(string), *(b.column(k).take(pa.array(i + row)) for k in (0, 2, 3)), pa.array((first - rows[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "g", "doc_id", "t1", "t2", "start", "n"]
                )

    return docs.filter("doc_id is not null").select("doc_id", "text", "t1", "t2").mapInArrow(scan, "h long, g long, doc_id long, t1 long, t2 long, start int, n int")


def cut_strings(found: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """h, g, lo and the packed string (words joined by one space) of chosen runs, which are grouped by document."""
    by_doc = found.groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct("h", "g", "start", "n", "doc_id")).alias("runs"))
    joined = docs.join(by_doc, same_row(docs, by_doc)).select(docs["text"], "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffers(b.column(0))
            lists = b.column(1)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            h, g, start, n, lo = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            for i in range(b.num_rows):
                split = _WORD.findall(data[offs[i] : offs[i + 1]].tobytes())
                at = range(bounds[i], bounds[i + 1])
                strings = [b" ".join(split[start[k] : start[k] + n[k] + window - 1]) for k in at]
                s = slice(bounds[i], bounds[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(g[s]), pa.array(lo[s]), pa.array(strings, pa.binary())], ["h", "g", "lo", "string"])

    return joined.mapInArrow(cut, "h long, g long, lo long, string binary")


def windows_of(strings: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window of packed strings: two hashes, its string's index and its place in the string."""
    data, offs = text_buffers(strings.cast(pa.large_binary()))
    data, offs = data[offs[0] : offs[-1]], offs - offs[0]
    hashes, start, end, rows = words(data, offs)
    n = np.maximum(np.diff(rows) - window + 1, 0)
    string = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    at = rows[:-1][string] + place
    # words of a packed string are one space apart, so a window is one span of bytes
    return windows(hashes, window)[at], span_hashes(prefix_hashes(data), start[at], end[at + window - 1]), string, place


def steps(h: np.ndarray, g: np.ndarray, string: np.ndarray, place: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of equal values along each string's windows, as columns h, g, a, b, low."""
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    count = np.diff(at, append=len(string))
    return {"h": h[string[at]], "g": g[string[at]], "a": place[at].astype(np.int32), "b": (place[at] + count).astype(np.int32), "low": low[at]}


def sorted_windows(bucket: pd.DataFrame, window: int) -> pd.DataFrame:
    """The smallest document of every window of a bucket's strings (h, g, lo, string), by sorting the windows."""
    one, two, string, place = windows_of(pa.array(bucket["string"], pa.binary()), window)
    lo = bucket["lo"].to_numpy()[string]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(lo[order], at), np.diff(at, append=len(order)))
    return pd.DataFrame(steps(bucket["h"].to_numpy(), bucket["g"].to_numpy(), string, place, least))


def removed_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most: int = MOST_STRINGS, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, t1, t2 and the word ranges [lo, hi) that windows of smaller documents cover, as an array for each row."""
    found = runs(docs, window, gram)
    several = written(found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h"))
    shared = written(found.join(several, "h"))
    discard(several)

    strings = written(shared.groupBy("h", "g").agg(F.min(F.struct("doc_id", "t1", "t2", "start", "n")).alias("m")).select("h", "g", "m.*"))
    sizes = written(strings.groupBy("h").agg(F.count("*").alias("strings"), F.sum("n").alias("windows")))
    kept = written(strings.join(sizes, "h"))
    discard(strings, sizes)
    wide = (F.col("strings") > most) | (F.col("windows") > most_windows)
    volume = kept.filter("strings > 1").agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0)), F.coalesce(F.max(wide), F.lit(False))).first()
    groups = max(1, int(volume[0] * 7 / bucket_bytes) + 1)

    packed = cut_strings(kept.filter("strings > 1").filter(~wide), docs, window)
    schema = "h long, g long, a int, b int, low long"
    sorted_ = packed.groupBy(F.pmod("h", F.lit(groups)).alias("grp")).applyInPandas(lambda pdf: sorted_windows(pdf, window), schema)
    alone = kept.filter("strings = 1").select("h", "g", F.lit(0).alias("a"), F.col("n").alias("b"), F.col("doc_id").alias("low"))
    lows = sorted_.unionByName(alone)
    if volume[1]:
        lows = lows.unionByName(in_windows(cut_strings(kept.filter("strings > 1").filter(wide), docs, window), window))
    lows = written(lows)
    discard(kept)
    hit = shared.join(lows, ["h", "g"]).filter("low < doc_id")
    spans = hit.select("doc_id", "t1", "t2", (F.col("start") + F.col("a")).alias("lo"), (F.col("start") + F.col("b") + (window - 1)).alias("hi"))
    spans = written(spans.groupBy("doc_id", "t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    discard(shared, lows)
    return spans


def in_windows(packed: DataFrame, window: int) -> DataFrame:
    """As sorted_windows(), for strings of any number: each window is a row, and Spark groups them."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two, string, place = windows_of(b.column(3), window)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(string)), b.column(1).take(pa.array(string)), b.column(2).take(pa.array(string)), pa.array(place.astype(np.int32)), int64s(one), int64s(two)], ["h", "g", "lo", "a", "one", "two"])

    rows = packed.select("h", "g", "lo", "string").mapInArrow(explode, "h long, g long, lo long, a int, one long, two long")
    least = rows.groupBy("one", "two").agg(F.min("lo").alias("low"))
    return rows.join(least, ["one", "two"]).select("h", "g", "a", (F.col("a") + 1).alias("b"), "low")


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most: int = MOST_STRINGS, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    source = keyed(docs, id_col, text_col)
    spans = removed_words(source, window, gram, bucket_bytes, most, most_windows)
    joined = source.join(spans, same_row(source, spans), "left").select(source["doc_id"], source["text"], F.expr("spans.lo").alias("lo"), F.expr("spans.hi").alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffers(b.column(1))
            total, gone, kept = [], [], []
            for i in range(b.num_rows):
                split = _WORD.findall(data[offs[i] : offs[i + 1]].tobytes())
                total.append(len(split))
                if b.column(2)[i].is_valid:
                    edges = np.zeros(len(split) + 1, np.int64)
                    np.add.at(edges, b.column(2)[i].values.to_numpy(), 1)
                    np.add.at(edges, b.column(3)[i].values.to_numpy(), -1)
                    stay = np.cumsum(edges[:-1]) == 0
                    split = [w for w, s in zip(split, stay.tolist(), strict=True) if s]
                gone.append(total[-1] - len(split))
                kept.append(b" ".join(split))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")

