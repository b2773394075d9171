"""Bytes covered by 400-byte strings that start more than once, found by sorting suffixes in buckets.

Windows of 400 bytes that share a minimiser (the 32 bytes of least hash in them) make runs. Equal windows have
equal minimisers, so those that occur twice do so within one minimiser's bucket.

1. Every run is counted at its minimiser by two hashes; a minimiser with one place has no repeated window. The
   counts are pre-aggregated and written before they are joined back: Spark splits the partition of a hot
   minimiser only where both sides of the join come from tables.
2. Where a bucket has one string only, many times, all its windows repeat. Where it has several, or one in which
   the minimiser repeats, one copy of each goes to a group of buckets, whose suffixes are sorted in two stages: only suffixes smaller than their
   successors are compared, the others follow from them by scans over the buckets of first bytes. Neighbours in
   that order with a common prefix of 400 bytes are repeated windows. Buckets of more than `most` strings
   or `most_bytes` bytes are taken apart into windows, which Spark groups, so a task never holds one whole.
3. Each run learns its repeated windows from its string, and each row the byte ranges to remove.
4. Repeats shorter than that stay, but are told of: see echoes().

Null and empty texts have no bytes. A null doc_id is a document like others; repeated rows are documents that
repeat each other. Windows never cross documents. Documents longer than a slice are read in overlapping slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import SLICE_BYTES, discard, int64s, keyed, minimiser_runs, prefix_hashes, same_row, slices, sliding_min, span_hashes, text_buffers, written

WINDOW, GRAM = 400, 32
#: Bytes of strings that a group of buckets has on average; strings of one minimiser, and their bytes, that are sorted in one task.
BUCKET_BYTES, MOST_STRINGS, MOST_BYTES = 2_000_000, 5_000, 8_000_000
#: Echoes: strings of ECHO bytes at the least hash of any ECHO_STEP neighbours, so each ECHO + ECHO_STEP - 1 bytes hold one whole.
ECHO, ECHO_STEP = 160, 128


def pieces(offs: np.ndarray, window: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Rows i to j and bytes a to b: whole rows, or a part of one long row that overlaps the next part by window - 1."""
    for i, j in slices(offs, most):
        a, b = int(offs[i]), int(offs[j])
        while b - a > most + window and j == i + 1:
            yield i, j, a, a + most + window - 1
            a += most
        yield i, j, a, b


def runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """h (minimiser), g (string), doc_id, t1, t2, start (byte), n (windows), p (places of the minimiser) of every run in the rows of keyed()."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for i, j, a, b in pieces(offs, window):
                o = np.clip(offs[i : j + 1], a, b) - a
                sums = prefix_hashes(data[a:b])
                at = np.arange(max(0, b - a - gram + 1))
                grams = span_hashes(sums, at, at + gram)
                first, n, place, places = minimiser_runs(grams, o, window, gram)
                if not len(first):
                    continue
                row = np.searchsorted(o, first, "right") - 1
                rows = pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [int64s(grams[place]), int64s(span_hashes(sums, first, first + n + (window - 1))), *(batch.column(k).take(rows) for k in (0, 2, 3)), pa.array((first + a - offs[i + row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(places.astype(np.int32))],
                    ["h", "g", "doc_id", "t1", "t2", "start", "n", "p"],
                )

    return docs.select("doc_id", "text", "t1", "t2").mapInArrow(scan, "h long, g long, doc_id long, t1 long, t2 long, start int, n int, p int")


def cut_strings(found: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """h, g, n, c and the bytes of chosen runs, which are grouped by document."""
    by_doc = found.groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct("h", "g", "start", "n", "c")).alias("runs"))
    joined = docs.join(by_doc, same_row(docs, by_doc)).select(docs["text"], "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(0))
            lists = batch.column(1)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            for i in range(batch.num_rows):
                s = flat.slice(bounds[i], bounds[i + 1] - bounds[i])
                h, g, start, n, c = (s.field(k) for k in range(5))
                strings = [data[offs[i] + x : offs[i] + x + y + window - 1].tobytes() for x, y in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([h, g, n, c, pa.array(strings, pa.binary())], ["h", "g", "n", "c", "string"])

    return joined.mapInArrow(cut, "h long, g long, n int, c long, string binary")


def sorted_directly(text: np.ndarray, at: np.ndarray, depth: int, sums: np.ndarray) -> np.ndarray:
    """Suffixes `at` in order of their first `depth` bytes, eight at a time; text ends in `depth` + 8 zeros.

    Groups that are still tied skip what all their members share, which hashes of the next bytes tell.
    """
    eight = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    key = eight[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    done = np.full(len(at), 8, np.int64)  # bytes known to be shared within the group
    while True:
        size = np.bincount(group)
        open_ = np.flatnonzero((size[group] > 1) & (done < depth))
        if not len(open_):
            return at
        g, s, d = group[open_], at[open_], done[open_]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        count = np.diff(start, append=len(g))
        skipped = np.zeros(len(g), bool)
        for step in (depth, 64):
            ahead = np.minimum(step, depth - d)
            x = span_hashes(sums, s + d, s + d + ahead)
            alike = np.repeat((np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start)), count) & ~skipped
            done[open_[alike]] += ahead[alike]
            skipped |= alike
        rest = open_[~skipped]
        if not len(rest):
            continue
        key = eight[at[rest] + done[rest]].astype(np.uint64)
        order = np.lexsort((key, group[rest]))
        at[rest] = at[rest][order]
        key, g = key[order], group[rest]
        done[rest] += 8
        apart = np.zeros(len(group), bool)
        apart[rest[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(apart)


def two_stage_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, needed: np.ndarray, depth: int, sums: np.ndarray) -> np.ndarray:
    """Suffixes of the strings text[starts:ends], in order of at least `depth` bytes, those before `needed` all included.

    Each string has a zero behind it, smaller than its bytes. Stage one sorts the suffixes smaller than their
    successors. Stage two scans buckets of first bytes from the smallest on: each suffix met puts the one before
    it, if that is larger than its successor, at the end of what its own bucket has so far.
    """
    n = int(ends[-1]) + 1
    t = text[:n].astype(np.int16)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    smaller = np.zeros(n, bool)
    inner = nxt < n - 1
    smaller[inner] = t[nxt[inner]] < t[nxt[inner] + 1]
    smaller[ends] = True  # the zeros
    where = np.flatnonzero(smaller)
    seed = where[np.searchsorted(where, np.minimum(needed, ends), "left")]  # the first at or after the last suffix needed
    wanted = np.zeros(n + 1, np.int64)
    wanted[starts] += 1
    np.add.at(wanted, seed + 1, -1)
    wanted = np.cumsum(wanted[:n]) > 0
    first = np.zeros(n, bool)
    first[starts] = True

    direct = sorted_directly(text, np.flatnonzero(smaller & wanted), depth, sums)
    head = t[direct]
    cuts = np.searchsorted(head, np.arange(258))
    larger: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(met: np.ndarray, own: int) -> np.ndarray:
        """Deals the larger suffixes before those met to their buckets; returns those of the bucket being scanned."""
        before = met[~first[met]] - 1
        before = before[~smaller[before] & wanted[before]]
        c = t[before]
        mine = before[c == own]
        before, c = before[c != own], c[c != own]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        for k in np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else ():
            larger[c[k]].append(before[k : np.searchsorted(c, c[k], "right")])
        return mine

    for c in range(257):
        met = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        while len(met):
            out.append(met)
            met = induce(met, c)
        met = direct[cuts[c] : cuts[c + 1]]
        if len(met):
            out.append(met)
            induce(met, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(sums: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to `most`, that each suffix shares with the one before it in the order (0 for the first)."""
    low = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return low
    a, b = order[:-1], order[1:]
    whole = span_hashes(sums, a, a + most) == span_hashes(sums, b, b + most)
    known = np.where(whole, most, 0)
    rest = np.flatnonzero(~whole)
    got = np.zeros(len(rest), np.int64)
    for bit in (1 << k for k in range(most.bit_length() - 1, -1, -1)):
        tried = np.minimum(got + bit, most)
        same = span_hashes(sums, a[rest], a[rest] + tried) == span_hashes(sums, b[rest], b[rest] + tried)
        got = np.where(same, tried, got)
    known[rest] = got
    low[1:] = known
    return low


def repeated_windows(bucket: pd.DataFrame, window: int) -> pd.DataFrame:
    """Ranges [a, b) of the windows of a bucket's strings (h, g, n, c, string) that start twice or more in all."""
    bucket = bucket.drop_duplicates(["h", "g"])  # a repeated row has cut its strings again
    lengths = bucket["string"].map(len).to_numpy(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    text = np.frombuffer(b"\xff".join(bucket["string"]) + b"\xff" * (window + 9), np.uint8) + np.uint8(1)  # the byte 255, in no UTF-8, becomes 0
    sums = prefix_hashes(text)
    n = bucket["n"].to_numpy(np.int64)
    order = two_stage_order(text, starts, ends, starts + n - 1, window, sums)
    string = np.searchsorted(starts, order, "right") - 1
    place = order - starts[string]
    is_window = place < n[string]
    order, string, place = order[is_window], string[is_window], place[is_window]
    new = common_prefixes(sums, order, window) < window
    at = np.flatnonzero(new)
    times = np.add.reduceat(bucket["c"].to_numpy(np.int64)[string], at) if len(at) else at
    twice = np.repeat(times > 1, np.diff(at, append=len(order)))
    flags = np.zeros(int(n.sum()), bool)
    base = np.cumsum(n) - n
    flags[(base[string] + place)[twice]] = True
    owner = np.repeat(np.arange(len(n)), n)
    before = np.r_[False, flags[:-1]] & np.r_[False, owner[1:] == owner[:-1]]
    after = np.r_[flags[1:], False] & np.r_[owner[1:] == owner[:-1], False]
    a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    s = owner[a]
    return pd.DataFrame({"h": bucket["h"].to_numpy()[s], "g": bucket["g"].to_numpy()[s], "a": (a - base[s]).astype(np.int32), "b": (b - base[s] + 1).astype(np.int32)})


def removed_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most: int = MOST_STRINGS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, t1, t2 and the byte ranges [lo, hi) to remove, as an array for each row."""
    found = written(runs(docs, window, gram))
    again = written(found.groupBy("h").agg(F.sum("p").alias("times")).filter("times > 1").select("h"))
    shared = written(found.join(again, "h"))
    discard(found, again)

    strings = written(shared.groupBy("h", "g").agg(F.count("*").alias("c"), F.max("p").alias("p"), F.min(F.struct("doc_id", "t1", "t2", "start", "n")).alias("m")).select("h", "g", "c", "p", "m.*"))
    sizes = written(strings.groupBy("h").agg(F.count("*").alias("strings"), F.sum(F.col("n") + window).alias("bytes")))
    kept = written(strings.join(sizes, "h"))
    discard(strings, sizes)
    mixed, plain = kept.filter("strings > 1 or p > 1"), kept.filter("strings = 1 and p = 1")
    wide = (F.col("strings") > most) | (F.col("bytes") > most_bytes)
    volume = mixed.agg(F.coalesce(F.sum(F.col("n") + window), F.lit(0)), F.coalesce(F.max(wide), F.lit(False))).first()
    groups = max(1, int(volume[0] / bucket_bytes) + 1)

    cut = cut_strings(mixed.filter(~wide), docs, window)
    ranges = cut.groupBy(F.pmod("h", F.lit(groups)).alias("grp")).applyInPandas(lambda pdf: repeated_windows(pdf, window), "h long, g long, a int, b int")
    ranges = ranges.unionByName(plain.select("h", "g", F.lit(0).alias("a"), F.col("n").alias("b")))
    if volume[1]:
        ranges = ranges.unionByName(in_windows(cut_strings(mixed.filter(wide), docs, window).dropDuplicates(["h", "g"]), window))
    ranges = written(ranges)
    discard(kept)
    hit = shared.join(ranges, ["h", "g"])
    spans = hit.select("doc_id", "t1", "t2", (F.col("start") + F.col("a")).alias("lo"), (F.col("start") + F.col("b") + (window - 1)).alias("hi"))
    spans = written(spans.groupBy("doc_id", "t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    discard(shared, ranges)
    return spans


def echoes(docs: DataFrame, size: int = ECHO, step: int = ECHO_STEP, gram: int = GRAM) -> DataFrame:
    """doc_id, t1, t2, n_echoes: the distinct strings of `size` bytes, one at least in `size` + `step` - 1 bytes, that other documents have too.

    Tells of repeats that are shorter than the windows, which stay. Places are chosen by their own bytes only, so
    equal passages choose equal strings. None for documents without.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for i, j, a, b in pieces(offs, size + step):
                o = np.clip(offs[i : j + 1], a, b) - a
                sums = prefix_hashes(data[a:b])
                at = np.arange(max(0, b - a - gram + 1))
                if len(at) < step:
                    continue
                mask = np.uint64((1 << int(b - a).bit_length()) - 1)
                place = np.unique(sliding_min((span_hashes(sums, at, at + gram) & ~mask) | at.astype(np.uint64), step) & mask).astype(np.int64)
                row = np.searchsorted(o, place, "right") - 1
                inside = place + size <= o[row + 1]
                place, row = place[inside], row[inside]
                rows = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([int64s(span_hashes(sums, place, place + size)), *(batch.column(k).take(rows) for k in (0, 2, 3))], ["e", "doc_id", "t1", "t2"])

    found = written(docs.select("doc_id", "text", "t1", "t2").mapInArrow(scan, "e long, doc_id long, t1 long, t2 long"))
    own = F.xxhash64("doc_id", "t1", "t2")
    several = written(found.groupBy("e").agg(F.min(own).alias("x"), F.max(own).alias("y")).filter("x < y").select("e"))
    out = written(found.join(several, "e").groupBy("doc_id", "t1", "t2").agg(F.size(F.collect_set("e")).alias("n_echoes")))
    discard(found, several)
    return out


def in_windows(cut: DataFrame, window: int) -> DataFrame:
    """As repeated_windows(), for strings of any number: each window is a row of two hashes, and Spark groups them."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = np.frombuffer(batch.column(4)[i].as_py(), np.uint8)
                at = np.arange(len(text) - window + 1)
                row = pa.array(np.full(len(at), i))
                one, two = span_hashes(prefix_hashes(text), at, at + window), span_hashes(prefix_hashes(text ^ np.uint8(0xA5)), at, at + window)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), batch.column(3).take(row), pa.array(at.astype(np.int32)), int64s(one), int64s(two)], ["h", "g", "c", "a", "one", "two"])

    rows = cut.select("h", "g", "n", "c", "string").mapInArrow(explode, "h long, g long, c long, a int, one long, two long")
    twice = rows.groupBy("one", "two").agg(F.sum("c").alias("times")).filter("times > 1").select("one", "two")
    return rows.join(twice, ["one", "two"]).select("h", "g", "a", (F.col("a") + 1).alias("b"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges as their union."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return lo[at], reach[np.r_[at[1:] - 1, len(lo) - 1]]


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most: int = MOST_STRINGS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and n_echoes (see echoes()) of every row."""
    source = keyed(docs, id_col, text_col)
    spans = removed_bytes(source, window, gram, bucket_bytes, most, most_bytes)
    short = echoes(source)
    joined = source.join(spans, same_row(source, spans), "left").join(short, same_row(source, short), "left")
    joined = joined.select(source["doc_id"], source["text"], F.expr("spans.lo").alias("lo"), F.expr("spans.hi").alias("hi"), F.coalesce("n_echoes", F.lit(0)).cast("long").alias("n_echoes"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data, offs = text_buffers(part.column(1))
                total, gone, count, kept = [], [], [], []
                for i in range(part.num_rows):
                    own = data[offs[i] : offs[i + 1]]
                    total.append(len(own))
                    los = his = np.zeros(0, np.int64)
                    if part.column(2)[i].is_valid:
                        los, his = merged(part.column(2)[i].values.to_numpy(), part.column(3)[i].values.to_numpy())
                    gone.append(int((his - los).sum()))
                    count.append(len(los))
                    kept.append(b"".join(own[x:y].tobytes() for x, y in zip(np.r_[0, his].tolist(), np.r_[los, len(own)].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), part.column(4)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_echoes"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_echoes long")
