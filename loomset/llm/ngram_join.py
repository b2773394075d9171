"""Jaccard self-join of documents on sets of word 5-grams: rare-first prefixes, three filters, one check per pair.

Texts with the same set of shingles form a class; classes are what is joined. A set's shingles are ordered from
rare to frequent, by counts over all documents in a table of fixed size, and its first n - ceil(0.8 n) + 1 make
the prefix: two sets of similarity 0.8 share a gram there.

1. One pass hashes every document to its class and counts shingles; a second gives the prefix rows.
2. Prefix rows meet by gram. A gram of one class ends there. A pair has to pass the length filter, the positional
   filter and the suffix filter (a bound on the sets' difference from counts over 256 parts of the hash space).
   In turns, each class shows its first few open grams; of the pairs of a gram that pass, a forest that would join
   them all is compared, each pair's texts once, and what verifies is contracted to components. Grams of one
   component are closed.
3. Grams that still join different components give all the pairs between them that pass the filters, each pair at
   the first place the two classes' open grams meet, and those not yet compared are. So a large group of near
   copies is never spelled out in pairs, and no link between components is lost.

Very frequent grams are dealt out by salt where single ones are sorted out, and in blocks of bounded size later.

Null and empty texts have no shingles and no links. Repeated rows are one class. A null doc_id takes part, and
counts as larger than others: its component is the smallest doc_id that isn't null, if there is one. Hashes have
64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.common import discard, int64s, keyed, mixed, same_row, slices, text_buffers, text_hashes, windows, words, written
from loomset.llm.components import components

SHINGLE = 5
#: Cells of the table of counts; parts of the suffix filter.
CELLS, BLOCKS, PARTS = 1 << 20, 64, 256
#: A cell is hot if it has this many times the mean count, and this many rows at least; its grams are salted.
HOT_TIMES, HOT_ROWS = 8, 50_000
#: Classes of one gram that are compared with each other in one task.
BLOCK_ROWS = 2000
#: Open grams of a class in a turn of forests; turns at most; a turn that joins less than one in so many open classes is the last.
RANKS, TURNS, TURN_SHARE = 6, 8, 50
#: Open grams before a place that tell whether two classes have met before.
LAST = 6


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, ascending; a row of fewer words is one shingle, of no words none."""
    hashes, _, _, rows = words(data, offs, lower=True)
    grams = windows(hashes, size)
    for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        if b - a >= size:
            x = np.sort(grams[a : b - size + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif b > a:
            yield mixed(windows(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_hash(x: np.ndarray) -> int:
    """64 bits of a set, whatever its order."""
    return int(mixed(np.array([mixed(x + np.uint64(1)).sum() + np.uint64(len(x))], np.uint64)).view(np.int64)[0])


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, offs = text_buffers(column)
    for i, j in slices(offs):
        yield from shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size)


def cell_of(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(44)).astype(np.int64)


def parts_of(x: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each part of the hash space, 255 standing for more."""
    return np.minimum(np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def classes_and_counts(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: doc_id, t1, t2, c, n, parts of every document, and block, counts of every task's shingles."""
    names = {"doc_id": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "c": pa.int64(), "n": pa.int32(), "parts": pa.binary(), "block": pa.int32(), "counts": pa.binary()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            c, n, parts = [], [], []
            held: list[np.ndarray] = []
            for x in sets_of(b.column(1), size):
                c.append(set_hash(x))
                n.append(len(x))
                parts.append(parts_of(x))
                held.append(cell_of(x))
                if len(held) == 256:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held = []
            if held:
                total += np.bincount(np.concatenate(held), minlength=CELLS)
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(parts, pa.binary()), *none], list(names))
        if total.any():
            cuts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(BLOCKS, -1)
            none = [pa.nulls(BLOCKS, t) for t in list(names.values())[:6]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in cuts], pa.binary())], list(names))

    return docs.select("doc_id", "text", "t1", "t2").mapInArrow(scan, "doc_id long, t1 long, t2 long, c long, n int, parts binary, block int, counts binary")


def summed(counts: DataFrame) -> np.ndarray:
    """The counts of all tasks: CELLS numbers, whatever the input's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), "<i4")
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    out = np.zeros((BLOCKS, CELLS // BLOCKS), np.int64)
    for r in counts.repartition(BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect():
        out[r.block] += np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """t (gram), s (salt; -1 for grams that aren't hot), c, n, i (place in the order) of every class's prefix."""
    hot = max(HOT_ROWS, HOT_TIMES * float(counts.mean()))
    salts = docs.sparkSession.sparkContext.broadcast(np.where(counts > hot, np.ceil(counts / hot), 0).astype(np.uint16))
    # counts as eighths of powers of two: one byte a cell
    order = docs.sparkSession.sparkContext.broadcast(np.rint(8 * np.log2(counts + 1)).astype(np.uint8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]

            def made() -> pa.RecordBatch:
                cols = [np.concatenate(x) for x in out]
                for x in out:
                    x.clear()
                return pa.RecordBatch.from_arrays([int64s(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4])], ["t", "s", "c", "n", "i"])

            rows = 0
            for x in sets_of(b.column(0), size):
                if not len(x) or (c := set_hash(x)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                p = prefix_length(len(x), percent)
                cell = cell_of(x)
                first = np.lexsort((x, order.value[cell]))[:p]
                salt = salts.value[cell[first]].astype(np.int32)
                out[0].append(x[first])
                out[1].append(np.where(salt > 0, c % 65521 % np.maximum(salt, 1), -1).astype(np.int32))
                out[2].append(np.full(p, c, np.int64))
                out[3].append(np.full(p, len(x), np.int32))
                out[4].append(np.arange(p, dtype=np.int32))
                rows += p
                if rows > 200_000:
                    yield made()
                    rows = 0
            if out[0]:
                yield made()

    return docs.select("text").mapInArrow(scan, "t long, s int, c long, n int, i int")


def meetings(rows: DataFrame) -> DataFrame:
    """Prefix rows t, c, n, i of grams that more than one class has.

    A pass over sorted partitions, which holds a row at a time from one batch to the next. Salted grams stay,
    since their other classes may be elsewhere.
    """
    names = ["t", "c", "n", "i"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far, which is out once its successor is known: t, s, c, n, i, whether it begins its gram
        for b in batches:
            t, s, c, n, i = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            if not len(t):
                continue
            if last:
                t, s, c, n, i = (np.r_[np.array([v], x.dtype), x] for v, x in zip(last[:5], (t, s, c, n, i), strict=True))
            head = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]
            fresh = head | np.r_[True, c[1:] != c[:-1]]  # tasks may have sent a class twice
            t, s, c, n, i, head = (x[fresh] for x in (t, s, c, n, i, head))
            if last:
                head[0] = last[5]
            alone = head & np.r_[head[1:], True] & (s < 0)
            last = (t[-1], s[-1], c[-1], n[-1], i[-1], head[-1])
            k = np.flatnonzero(~alone[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (t, c, n, i)], names)
        if last and not (last[5] and last[1] < 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.array([last[k]])) for k in (0, 2, 3, 4)], names)

    dealt = rows.repartition("t", "s").sortWithinPartitions("t", "s", "c")
    return dealt.mapInArrow(scan, "t long, c long, n int, i int")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose sets are alike enough, each compared once. texts: c, text."""
    left, right = texts.select(F.col("c").alias("a"), F.col("text").alias("x")), texts.select(F.col("c").alias("b"), F.col("text").alias("y"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                same = []
                for x, y in zip(sets_of(part.column(2), size), sets_of(part.column(3), size), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    same.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def possible(na: np.ndarray, nb: np.ndarray, ia: np.ndarray, ib: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of these sizes that first meet at these places can be alike enough; the most they may differ."""
    least = -(-(na + nb) * percent // (100 + percent))
    fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return fits & (np.minimum(na - ia, nb - ib) >= least), na + nb - 2 * least


def forest(keys: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (j, k) of a group whose keys differ and that near(j, ks) doesn't rule out (it gives distances, -1 for no).

    Unless whole, a pair makes its two keys one, and of several ways to a key the nearest is taken, so there are
    fewer pairs than rows.
    """
    keys = keys.copy()
    for j in range(len(keys) - 1):
        ks = j + 1 + np.flatnonzero(keys[j + 1 :] != keys[j])
        if not len(ks):
            continue
        apart = near(j, ks)
        ks, apart = ks[apart >= 0], apart[apart >= 0]
        if whole or not len(ks):
            yield np.full(len(ks), j), ks
            continue
        ks = ks[np.argsort(apart, kind="stable")]
        _, first = np.unique(keys[ks], return_index=True)
        yield np.full(len(first), j), ks[first]
        keys[np.isin(keys, keys[ks[first]])] = keys[j]


def still_open(rows: DataFrame) -> DataFrame:
    """The rows t, c, n, i, comp of grams that more than one component has, with their number m in the gram."""
    grams = rows.groupBy("t").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    return rows.select("t", "c", "n", "i", "comp").join(grams.select("t", "m"), "t")


def candidates(rows: DataFrame, parts: DataFrame, percent: int, turn: int | None) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix gram and pass the filters. rows: those of still_open(); parts: c, parts.

    With a turn, each class shows its first RANKS open grams only, and each gram gives a forest, in an order that
    changes from turn to turn. Without, all pairs come out, each where the two classes' open grams first meet: a
    gram is passed over if an earlier one is among the LAST before it of both. A gram's classes are compared in
    blocks: its rows are dealt to every pair of blocks, so that a task holds two blocks of one gram at most.
    """
    whole = turn is None
    along = Window.partitionBy("c").orderBy("i")
    if whole:  # c stands for no gram: it's never another class's
        placed = rows.withColumn("before", F.array(*(F.coalesce(F.lag("t", k).over(along), "c") for k in range(1, LAST + 1))))
    else:
        placed = rows.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= RANKS).drop("rank").withColumn("before", F.array().cast("array<long>"))
    placed = placed.join(parts, "c").withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int"))
    own = F.pmod(F.hash("c"), F.col("blocks"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y")))
    dealt = placed.withColumn("own", own).withColumn("xy", F.explode(met)).select("t", "xy.x", "xy.y", "own", "c", "n", "i", "comp", "parts", "before")
    dealt = dealt.repartition("t", "x", "y").sortWithinPartitions("t", "x", "y", F.xxhash64("c", F.lit(turn or 0)))

    def pairs_of(ready: pa.Table, at: np.ndarray) -> np.ndarray:
        x, y, own, c, n, i, comp = (ready.column(k).to_numpy() for k in range(1, 8))
        n, i = n.astype(np.int64), i.astype(np.int64)
        parts = np.frombuffer(b"".join(ready.column(8).to_pylist()), np.uint8).reshape(-1, PARTS)
        before = ready.column(9).combine_chunks().flatten().to_numpy().reshape(ready.num_rows, -1)
        size = np.diff(at, append=ready.num_rows)
        out = []

        def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fits, most = possible(n[a], n[b], i[a], i[b], percent)
            fits &= (x[a] == y[a]) | (own[a] != own[b])  # two rows of one block meet where that block meets itself
            got = np.full(len(b), -1, np.int64)
            where = np.flatnonzero(fits)
            for k in range(0, len(where), 20_000):
                w = where[k : k + 20_000]
                met = np.zeros(len(w), bool)
                for p in before.T:
                    met |= (p[a[w], None] == before[b[w]]).any(1)
                w = w[~met]
                apart = np.abs(parts[a[w]].astype(np.int16) - parts[b[w]]).sum(1)
                got[w] = np.where(apart <= most[w], apart, -1)
            return got

        group = np.repeat(np.arange(len(at)), size)
        small = size[group] <= 6
        for lag in range(1, 6):
            k = np.flatnonzero(small[:-lag] & (group[lag:] == group[:-lag]) & (comp[lag:] != comp[:-lag])) if len(group) > lag else ()
            if len(k):
                k = k[distance(k, k + lag) >= 0]
                out.append((c[k], c[k + lag]))
        for g in np.flatnonzero(size > 6):
            first = int(at[g])
            for a, b in forest(comp[first : first + size[g]], lambda j, ks, f=first: distance(np.full(len(ks), f + j), f + ks), whole):
                out.append((c[first + a], c[first + b]))
        if not out:
            return np.zeros((0, 2), np.int64)
        p, q = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        return np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _with_end(batches):
            if b is not None:
                rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if rest is None or not rest.num_rows:
                continue
            t, x, y = (rest.column(k).to_numpy() for k in range(3))
            at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            if b is not None:  # the last group may go on
                ready, rest, at = rest.slice(0, int(at[-1])), rest.slice(int(at[-1])), at[:-1]
            else:
                ready, rest = rest, None
            if ready.num_rows:
                found = pairs_of(ready, at)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return dealt.mapInArrow(scan, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def linked(rows: DataFrame, parts: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of every class that a link joins to another. rows: t, c, n, i; parts: c, parts; texts: c, text.

    Turns of forests go on as long as they join one in TURN_SHARE of the classes that are still open; what is left
    between components is then compared whole.
    """
    live = written(still_open(rows.withColumn("comp", F.col("c"))))
    links = compared = None
    for turn in range(TURNS):
        pairs = candidates(live, parts, percent, turn)
        pairs = written(pairs.join(compared, ["a", "b"], "left_anti") if compared else pairs)
        found = written(verified(pairs, texts, size, percent))
        compared, links = (compared.unionByName(pairs), links.unionByName(found)) if compared else (pairs, found)
        if not (joined := found.count()):
            break
        labels = components(links).withColumnRenamed("component", "now")
        relabelled = live.join(labels, live["c"] == labels["node"], "left").select("t", "c", "n", "i", F.coalesce("now", "c").alias("comp"))
        before, live = live, written(still_open(relabelled))
        discard(before)
        if TURN_SHARE * joined < live.agg(F.count_distinct("c")).first()[0]:
            break
    pairs = candidates(live, parts, percent, None).join(compared, ["a", "b"], "left_anti")
    return components(links.unionByName(written(verified(pairs, texts, size, percent))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id (the smallest doc_id reachable by links) and comp (the component's key, null without shingles) of every row."""
    source = keyed(docs, id_col, text_col)
    known = written(classes_and_counts(source, size))
    of_docs = known.filter("c is not null")
    counts = summed(known.filter("block is not null").select("block", "counts"))
    rows = written(meetings(prefixes(source, counts, size, percent)))

    met = rows.select("c").distinct()
    one_of = of_docs.groupBy("c").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("m"), F.first("parts").alias("parts")).join(met, "c").select("c", "m.*", "parts")
    classes = written(one_of)
    texts = source.join(classes, same_row(source, classes)).select("c", source["text"])
    if not of_docs.groupBy("doc_id", "t1", "t2").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["c"])
    texts = written(texts)
    whole = linked(rows, classes.select("c", "parts"), texts, size, percent)
    whole = written(whole)  # small sides are written first, so that Spark can split a hot class or component
    discard(rows, classes, texts)

    joined = of_docs.join(whole, F.col("c") == F.col("node"), "left").select("doc_id", "t1", "t2", "n", F.coalesce("component", "c").alias("comp"))
    joined = written(joined)
    least = written(joined.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least")))
    discard(known, whole)
    out = joined.join(least, "comp", "left")
    return out.select("doc_id", "t1", "t2", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("comp")).alias("comp"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """The rows of the smallest doc_id of each component, and those without shingles; a row that repeats stays once."""
    places = near_duplicates(docs, id_col, text_col, size, percent)
    place = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")]
    placed = places.select("comp", *place)
    best = placed.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("__null", "__id", "__t1", "__t2")).alias("m")).select("m.__id", "m.__null", "m.__t1", "m.__t2")
    stay = best.unionByName(placed.filter("comp is null").select("__id", "__null", "__t1", "__t2")).distinct()
    hashes = text_hashes(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__id"), F.col(id_col).isNull().alias("__null"), hashes[0].alias("__t1"), hashes[1].alias("__t2")]
    own = docs.select(F.struct("*").alias("row"), *key)  # in a struct no column's name can clash
    return own.join(stay, ["__id", "__null", "__t1", "__t2"], "left_semi").dropDuplicates(["__id", "__null", "__t1", "__t2"]).select("row.*")
