"""Benchmark passages in documents: SimHash fingerprints of item-sized windows, found by a multi-index, compared exactly.

A document leaks an item if one of its windows, as long as the item in words, has a weighted Jaccard similarity
of 0.8 or more with it: sums of the smaller over sums of the larger counts of word 5-grams. Words are compared in
lower case. Such a window shares a 5-gram with the item, so windows are looked at only where a document has a
5-gram of an item of their length; that loses nothing.

1. Each such window gets a 64-bit SimHash, by sums that slide along the words. The k-th occurrence of a 5-gram in a
   window is a feature of its own, so fingerprints measure the counts as sets and a repeated 5-gram (a mask, a rule
   of dashes) weighs no more than others.
2. Items of one length have a multi-index: fingerprints are cut into BLOCKS blocks, and each block's values within
   RADIUS // BLOCKS bits of an item's lead to the item. Two fingerprints within RADIUS bits are that near in a block
   at least, so the lookups find every such pair; their whole distance is then held against RADIUS.
3. The windows found are compared with their items by exact shared weight, counted for all of a stretch at once: the
   k-th occurrence of a 5-gram in a window counts if the item has it k times or more.

A window that just reaches the similarity shares eight ninths of the features, so a bit differs with a probability of
0.15: ten bits on average, with a spread of three. RADIUS leaves more than four spreads of room; tests measure the
recall over all windows of similarity 0.8 by brute force. A document shorter than an item is compared with it at once.

Items shorter than five words are one shingle each. Null and empty texts, of either table, leak nothing and match
nothing. Repeated rows give repeated results; a null doc_id is carried along. The items are a stated query set:
they go to the tasks in blocks of a bounded number of bytes, one block after another.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import mixed, slices, text_buffers, windows, words

SHINGLE, PERCENT = 5, 80
#: Bits within which the multi-index finds every pair of fingerprints, and the blocks that it cuts them into.
RADIUS, BLOCKS = 23, 8
#: UTF-8 bytes of items that a task holds at once; window starts that are fingerprinted at once.
ITEM_BYTES, STARTS = 4 << 20, 16_384

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_WIDE = 64 // BLOCKS
_NEAR = np.array([m for m in range(1 << _WIDE) if m.bit_count() <= RADIUS // BLOCKS])


def signs(features: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each hash."""
    return np.where(features[:, None] & _BITS, np.int32(1), np.int32(-1))


def fingerprints(grams: np.ndarray, count: int) -> np.ndarray:
    """SimHash of each run of `count` neighbouring grams, the k-th occurrence of a gram in the run a feature of its own."""
    n = len(grams)
    place = np.arange(n)
    order = np.argsort(grams, kind="stable")
    kind = np.empty(n, np.int64)
    kind[order] = np.cumsum(np.r_[False, np.diff(grams[order]) != 0])
    key = kind[order] * (n + count + 1) + order  # by gram, then place
    rank = np.empty(n, np.int64)
    rank[order] = place
    base = kind * (n + count + 1)
    # a gram that comes in is the so-many-th of its run; one that goes takes the last of its kind away
    enters = rank - np.searchsorted(key, base + np.maximum(place - count + 1, 0)) + 1
    leaves = np.searchsorted(key, base + place + count) - rank
    sums = np.zeros((n + 1, 64), np.int32)
    np.cumsum(signs(mixed(grams + enters.astype(np.uint64))), axis=0, out=sums[1:])
    gone = np.zeros((n - count + 1, 64), np.int32)
    np.cumsum(signs(mixed(grams[: n - count] + leaves[: n - count].astype(np.uint64))), axis=0, out=gone[1:])
    return ((sums[count:] - gone) > 0) @ _BITS


class MultiIndex:
    """Fingerprints to be found by any within RADIUS bits of them."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.blocks = prints, []
        for k in range(BLOCKS):
            value = (prints >> np.uint64(k * _WIDE)).astype(np.int64) & ((1 << _WIDE) - 1)
            near = (value[:, None] ^ _NEAR).reshape(-1)
            order = np.argsort(near, kind="stable")
            self.blocks.append((np.searchsorted(near[order], np.arange((1 << _WIDE) + 1)), order // len(_NEAR)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (given fingerprint, indexed one) within the radius, by their places."""
        pairs = []
        for k, (bounds, held) in enumerate(self.blocks):
            value = (prints >> np.uint64(k * _WIDE)).astype(np.int64) & ((1 << _WIDE) - 1)
            count = bounds[value + 1] - bounds[value]
            given = np.repeat(np.arange(len(prints)), count)
            at = np.arange(len(given)) - np.repeat(np.cumsum(count) - count, count) + bounds[value][given]
            pairs.append(given * len(self.prints) + held[at])
        given, own = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.prints)))
        close = np.bitwise_count(prints[given] ^ self.prints[own]) <= RADIUS
        return given[close], own[close]


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Shared and whole weight of two bags of shingles."""
    both = np.concatenate([x, y])
    _, at = np.unique(both, return_inverse=True)
    n = int(at.max()) + 1
    p, q = np.bincount(at[: len(x)], minlength=n), np.bincount(at[len(x) :], minlength=n)
    return int(np.minimum(p, q).sum()), int(np.maximum(p, q).sum())


def shared_weights(part: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Shared weight with the item's bag of shingles of each run of as many neighbouring shingles."""
    count = len(item)
    starts = len(part) - count + 1
    kinds, most = np.unique(item, return_counts=True)
    kind = np.minimum(np.searchsorted(kinds, part), len(kinds) - 1)
    at = np.flatnonzero(kinds[kind] == part)
    at = at[np.argsort(kind[at], kind="stable")]  # by shingle, then place
    k = kind[at]
    # a place counts for windows that begin behind the place `most` occurrences before it
    before = np.arange(len(at)) - most[k]
    same = before >= np.searchsorted(k, k, "left")
    lo = np.maximum((at - count + 1).clip(0), np.where(same, at[before.clip(0)] + 1, 0))
    hi = np.minimum(at, starts - 1)
    held = lo <= hi
    steps = np.bincount(lo[held], minlength=starts + 1) - np.bincount(hi[held] + 1, minlength=starts + 1)
    return np.cumsum(steps)[:starts]


class Items:
    """Shingles of some items and, by length in words, a multi-index of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], size: int = SHINGLE):
        data, offs = text_buffers(pa.array(texts, pa.string()))
        hashes, _, _, rows = words(data[offs[0] : offs[-1]], offs - offs[0], lower=True)
        self.size, self.ids, self.lengths, self.grams = size, [], [], []
        for i, (a, b) in zip(ids, zip(rows.tolist(), rows[1:].tolist(), strict=False), strict=True):
            if b > a:
                self.ids.append(i)
                self.lengths.append(b - a)
                self.grams.append(windows(hashes[a:b], min(size, b - a)))
        widths = sorted({min(size, n) for n in self.lengths})
        #: by width in words (that of a shingle, or of a shorter item): shingles and the items that have each
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.marked: dict[int, np.ndarray] = {}
        for w in widths:
            own = [k for k, n in enumerate(self.lengths) if min(size, n) == w]
            grams, item = np.concatenate([self.grams[k] for k in own]), np.concatenate([np.full(len(self.grams[k]), k) for k in own])
            order = np.argsort(grams, kind="stable")
            self.known[w] = (grams[order], item[order])
            self.marked[w] = np.zeros(1 << 20, bool)
            self.marked[w][(grams >> np.uint64(44)).astype(np.int64)] = True
        self.of_length = {n: np.array([k for k, m in enumerate(self.lengths) if m == n]) for n in set(self.lengths)}
        self.index = {n: MultiIndex(np.array([fingerprints(self.grams[k], len(self.grams[k]))[0] for k in own], np.uint64)) for n, own in self.of_length.items()}

    def suspects(self, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows of a slice that hold a shingle of some item."""
        out = []
        for w, (grams, _) in self.known.items():
            own = windows(hashes, w)
            at = np.flatnonzero(self.marked[w][(own >> np.uint64(44)).astype(np.int64)])
            at = at[grams[np.minimum(np.searchsorted(grams, own[at]), len(grams) - 1)] == own[at]]
            row = np.searchsorted(rows, at, "right") - 1
            out.append(row[at + w <= rows[row + 1]])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def found_in(self, hashes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, int, int, int]]:
        """(item, first word, end word, shared, whole) of the best window of each stretch of a document that leaks an item."""
        out = []
        lengths = np.array(self.lengths)
        for w, (grams, item) in self.known.items():
            own = windows(hashes, w)
            lo, hi = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
            met: dict[int, list[int]] = {}
            for k in np.flatnonzero(hi > lo).tolist():
                for n in np.unique(lengths[item[lo[k] : hi[k]]]).tolist():
                    met.setdefault(n, []).append(k)
            for n, where in sorted(met.items()):
                if len(hashes) < n:  # the whole document is the window
                    for i in np.unique(item[np.concatenate([np.arange(lo[k], hi[k]) for k in where])]).tolist():
                        if self.lengths[i] == n:
                            out += self._compared(i, [(0, *similarity(own, self.grams[i]))], len(hashes), percent)
                else:
                    out += self._windows(n, own, where, len(hashes), percent)
        return out

    def _windows(self, n: int, own: np.ndarray, where: list[int], size: int, percent: int) -> list[tuple]:
        """Leaks of items of n words, from the windows that hold a shingle at one of the places."""
        count, last = len(self.grams[self.of_length[n][0]]), size - n
        spans: list[list[int]] = []  # of windows' first words
        for k in where:
            a, b = max(0, k - count + 1), min(k, last)
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], b)
            elif a <= b:
                spans.append([a, b])
        out = []
        for a, b in spans:
            found: dict[int, list[np.ndarray]] = {}
            for start in range(a, b + 1, STARTS):
                given, held = self.index[n].near(fingerprints(own[start : min(start + STARTS, b + 1) + count - 1], count))
                for i in np.unique(held).tolist():
                    found.setdefault(i, []).append(given[held == i] + start)
            for i, starts in sorted(found.items()):
                at = np.concatenate(starts)
                first = int(at[0])
                weights = shared_weights(own[first : int(at[-1]) + count], self.grams[self.of_length[n][i]])[at - first]
                best = int(weights.argmax())
                out += self._compared(int(self.of_length[n][i]), [(int(at[best]), int(weights[best]), 2 * count - int(weights[best]))], size, percent)
        return out

    def _compared(self, item: int, windows_: list[tuple[int, int, int]], size: int, percent: int) -> list[tuple]:
        return [(item, s, min(s + self.lengths[item], size), shared, whole) for s, shared, whole in windows_ if 100 * shared >= percent * whole]


def item_blocks(items: DataFrame, item_id: str, item_text: str, item_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the items, so many bytes at a time, dealt by a hash."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(total / item_bytes) + 1
    for k in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield [r.item_id for r in held], [r.text for r in held]


def _found(items: Items, column: pa.Array, percent: int) -> Iterator[tuple[int, list[tuple]]]:
    """Row and leaks of each text that leaks."""
    data, offs = text_buffers(column)
    for i, j in slices(offs):
        hashes, _, _, rows = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
        for row in items.suspects(hashes, rows).tolist():
            if got := items.found_in(hashes[rows[row] : rows[row + 1]], percent):
                yield i + row, got


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, end_word and similarity of every stretch of a document that leaks an item."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names, types = ["doc_id", "item_id", "first_word", "end_word", "similarity"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]

    def searched(ids: list[int], texts: list[str]) -> DataFrame:
        block = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Items(*block.value)
            for b in batches:
                out = [(b.column(0)[row].as_py(), held.ids[k], x, y, shared / whole) for row, got in _found(held, b.column(1), percent) for k, x, y, shared, whole in got]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

        return docs.mapInArrow(scan, "doc_id long, item_id long, first_word int, end_word int, similarity double")

    return functools.reduce(DataFrame.unionByName, (searched(*x) for x in item_blocks(items, item_id, item_text, item_bytes)))


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows that leak no item, all their columns as they were."""
    place = docs.columns.index(text_col)

    def cleaned(rows: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
        block = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Items(*block.value)
            for b in batches:
                stay = np.ones(b.num_rows, bool)
                stay[[row for row, _ in _found(held, b.column(place), percent)]] = False
                yield b.filter(pa.array(stay))

        return rows.mapInArrow(scan, docs.schema)

    return functools.reduce(lambda rows, x: cleaned(rows, *x), item_blocks(items, item_id, item_text, item_bytes), docs)
