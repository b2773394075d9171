"""Lines that many documents share, dropped from all of them: cuckoo filters in shards, backed by exact counts.

A line's key is the line without white space at both ends, A-Z lower-cased; two 64-bit hashes stand for it.

1. `counts` has each key's exact number of documents. Tasks send a key once for each document; Spark adds them up
   before and after its shuffle, so a line that every document has is no hot row.
2. `filters` has a cuckoo filter for each shard of keys (a range of hashes), holding the keys that reach the
   threshold. Documents that arrive raise counts and documents that leave lower them; keys that cross the
   threshold go into, or out of, their shard's filter, and shards without such a key keep theirs. So adding
   documents and taking them away again restores the counts and what is dropped.
3. A document's lines are held against the filters first. Few pass that aren't to be dropped, and those are found
   out by a join with the exact counts. Filters are sent to the tasks only up to FILTER_BYTES in all; beyond that
   every line goes to the join with the counts, whose hot keys Spark splits.

Each row is a document, repeated rows too. A null or empty text has one empty line. Empty keys have no code point
and stay. A document whose lines all go has an empty text. Rows with null ids are documents like others. Columns
other than the id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm import cuckoo
from loomset.llm.common import _LOWER, _SEP, discard, int64s, keyed, mixed, prefix_hashes, prefix_of, same_row, slices, span_hashes, text_buffers, written

#: Documents that must have a line before it goes, and code points that its key has at least.
MIN_DOCS, MIN_CHARS = 10, 1
#: Keys at the threshold that a shard's filter holds on average, and bytes of filters that are sent to each task.
SHARD_KEYS, FILTER_BYTES = 50_000, 32 << 20
#: Documents whose kept lines go back from a task at once.
ROWS = 128
_KEY = "a long, b long"
_CODES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of rows in data (offs from 0), stripped: first byte, end byte, and n + 1 offsets of rows in lines."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offs[1:]]))
    rows = np.searchsorted(breaks, offs) + np.arange(len(offs))
    solid = np.flatnonzero(~_SEP[data])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = hi > lo
    first, last = start.copy(), start.copy()
    first[some], last[some] = solid[lo[some]], solid[hi[some] - 1] + 1
    return first, last, rows


def line_keys(data: np.ndarray, offs: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines whose keys are long enough: row, place in the row, and the key's two hashes."""
    start, end, rows = line_spans(data, offs)
    low = _LOWER[data]
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    at = np.flatnonzero(chars[end] - chars[start] >= min_chars)
    row = np.searchsorted(rows, at, "right") - 1
    start, end = start[at], end[at]
    return row, at - rows[row], span_hashes(prefix_hashes(low), start, end), span_hashes(prefix_of(_CODES[low]), start, end)


def _shard(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def lines_of(docs: DataFrame, min_chars: int, filters: dict[int, bytes] | None = None, shards: int = 1) -> DataFrame:
    """doc_id, t1, t2, the key a, b and its places in the document, a row for each key of a document; with filters, only keys that may be in them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: cuckoo.loaded(f) for s, f in (filters or {}).items()}
        for batch in batches:
            data, offs = text_buffers(batch.column(3))
            for i, j in slices(offs):
                row, place, a, b = line_keys(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], min_chars)
                if filters is not None:
                    shard, may = _shard(a, shards), np.zeros(len(a), bool)
                    for s in np.unique(shard).tolist():
                        if s in tables:
                            of = np.flatnonzero(shard == s)
                            may[of] = cuckoo.contains(tables[s], a[of])
                    row, place, a, b = row[may], place[may], a[may], b[may]
                order = np.lexsort((place, b, a, row))
                row, place, a, b = row[order], place[order], a[order], b[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                at = np.flatnonzero(new)
                every = pa.array(i + row[at])
                places = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(every) for k in range(3)), int64s(a[at]), int64s(b[at]), places], ["doc_id", "t1", "t2", "a", "b", "places"])

    return docs.select("doc_id", "t1", "t2", "text").mapInArrow(scan, f"doc_id long, t1 long, t2 long, {_KEY}, places array<int>")


def _counts(docs: DataFrame, min_chars: int) -> DataFrame:
    return lines_of(docs, min_chars).groupBy("a", "b").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class LineStore:
    """Counts and filters of the documents taken in so far; every change gives a new store, whose tables are written in the shared folder.

    counts: a, b, n (documents that have the key). filters: shard, filter (bytes). A store that is no longer
    needed is freed by discard().
    """

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    shard_keys: int

    @staticmethod
    def of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineStore:
        """The store of a first set of documents, which may be empty."""
        counts = written(_counts(keyed(docs, id_col, text_col), min_chars))
        many = counts.filter(F.col("n") >= min_docs)
        shards = max(1, -(-many.count() // shard_keys))
        return LineStore(counts, _built(many, shards), shards, min_docs, min_chars, shard_keys)

    def added(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """The store with these documents too."""
        return self._changed(_counts(keyed(docs, id_col, text_col), self.min_chars))

    def removed(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineStore:
        """The store without these documents, which must have been taken in (ValueError otherwise)."""
        return self._changed(_counts(keyed(docs, id_col, text_col), self.min_chars).withColumn("n", -F.col("n")))

    def _changed(self, delta: DataFrame) -> LineStore:
        both = self.counts.withColumn("d", F.lit(0).cast("long")).unionByName(delta.select("a", "b", F.lit(0).cast("long").alias("n"), F.col("n").alias("d")))
        both = written(both.groupBy("a", "b").agg(F.sum("n").alias("was"), (F.sum("n") + F.sum("d")).alias("n")))
        if both.filter("n < 0").limit(1).count():
            discard(both)
            raise ValueError("documents that were never taken in can't be removed")
        many = both.filter(F.col("n") >= self.min_docs)
        keys, shards = many.count(), self.shards
        if keys > 2 * shards * self.shard_keys:
            shards = -(-keys // self.shard_keys)
            filters = _built(many, shards)
        else:
            enters, leaves = (F.col("n") >= self.min_docs) & (F.col("was") < self.min_docs), (F.col("n") < self.min_docs) & (F.col("was") >= self.min_docs)
            moves = both.filter((F.col("n") >= self.min_docs) | leaves).select(_shard_of(shards).alias("shard"), "a", F.when(enters, 1).when(leaves, -1).otherwise(0).alias("way"))
            touched = moves.filter("way <> 0").select("shard").distinct()
            # all keys of a touched shard come along, should its filter have to grow
            filters = written(self.filters.groupBy("shard").cogroup(moves.join(touched, "shard", "leftsemi").groupBy("shard")).applyInPandas(_updated, "shard long, filter binary"))
        counts = written(both.filter("n > 0").select("a", "b", "n"))
        discard(both)
        return LineStore(counts, filters, shards, self.min_docs, self.min_chars, self.shard_keys)

    def discard(self) -> None:
        discard(self.counts, self.filters)

    def dropped(self, source: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, t1, t2 and the places of the lines that go, from the rows of keyed()."""
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
        filters = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()} if size <= filter_bytes else None
        sure = lines_of(source, self.min_chars, filters, self.shards).join(self.counts.filter(F.col("n") >= self.min_docs).select("a", "b"), ["a", "b"])
        return written(sure.groupBy("doc_id", "t1", "t2").agg(F.flatten(F.collect_set("places")).alias("places")))

    def cleaned(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped and kept (the lines that stay, as bytes) of every row."""
        source = keyed(docs, id_col, text_col)
        gone = self.dropped(source, filter_bytes)
        joined = source.join(gone, same_row(source, gone), "left").select(source["doc_id"], source["text"], "places")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    b = batch.slice(at, ROWS)
                    total, dropped, kept = [], [], []
                    data, offs = text_buffers(b.column(1))
                    for i, places in enumerate(b.column(2)):
                        text = data[offs[i] : offs[i + 1]].tobytes()
                        n, gone = text.count(b"\n") + 1, 0
                        if places.is_valid:
                            stay = np.ones(n, bool)
                            stay[places.values.to_numpy()] = False
                            text, gone = b"\n".join(line for line, s in zip(text.split(b"\n"), stay.tolist(), strict=True) if s), n - int(stay.sum())
                        total.append(n)
                        dropped.append(gone)
                        kept.append(text)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

        return joined.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept binary")


def _shard_of(shards: int) -> Column:
    """The shard of column a, as _shard() has it."""
    return F.shiftright((F.shiftrightunsigned("a", 32) * shards), 32)


def _built(keys: DataFrame, shards: int) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's keys; of shards without keys too."""
    every = keys.sparkSession.range(shards).select(F.col("id").alias("shard"), F.lit(0).cast("long").alias("a"), F.lit(False).alias("real"))
    rows = keys.select(_shard_of(shards).alias("shard"), "a", F.lit(True).alias("real")).unionByName(every)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = pdf["a"].to_numpy()[pdf["real"].to_numpy()].view(np.uint64)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [cuckoo.stored(cuckoo.built(hashes))]})

    return written(rows.groupBy("shard").applyInPandas(build, "shard long, filter binary"))


def _updated(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after its keys' crossings; built anew where it has become too full."""
    if moves.empty:
        return old[["shard", "filter"]]
    table = cuckoo.loaded(old["filter"].iloc[0]).copy()
    hashes, way = moves["a"].to_numpy().view(np.uint64), moves["way"].to_numpy()
    cuckoo.delete(table, hashes[way < 0])
    if not cuckoo.insert(table, hashes[way > 0]):
        table = cuckoo.built(hashes[way >= 0])
    return pd.DataFrame({"shard": [int(old["shard"].iloc[0])], "filter": [cuckoo.stored(table)]})


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that at least `min_docs` of them share: doc_id, n_lines, n_dropped, kept."""
    return LineStore.of(docs, id_col, text_col, min_docs, min_chars).cleaned(docs, id_col, text_col)
