"""What the operators share: reading tables, the shared folder, and hashing of words in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text whose hashes are held at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under the folder that the cluster shares (spark.checkpoint.dir).

    Where that setting is absent, a temporary folder takes its place, but only on a local master: executors of a
    cluster could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomset-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomset-{uuid.uuid4().hex}"


#: Spark removes an execution's shuffle files at its end where this is set; nothing reads them once a table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet into the shared folder and read again: lineage ends here, and the shuffle files go."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables from written() that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), t1 and t2, two 64-bit hashes that tell texts of one doc_id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns(dict(zip(("t1", "t2"), text_hashes(F.col("text")), strict=True)))


def text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes in total, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_of(values: np.ndarray) -> np.ndarray:
    """n + 1 sums over 64-bit values; span_hashes() gives the hash of any run of them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """prefix_of() for bytes."""
    return prefix_of(data.astype(np.uint64) + np.uint64(1))


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(_UNBASE, len(sums))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the rows in data (offs from 0): hash, first byte, end byte, and n + 1 offsets of rows in words."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return span_hashes(prefix_hashes(data), start, end), start, end, np.searchsorted(start, offs)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size values (those that cross rows too; the caller leaves them out)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k : k + n]
    return mixed(out)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by minima from both ends of blocks of that width."""
    n = len(v)
    if n < width:
        return v[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def minimiser_runs(grams: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of `size` units that share one minimiser: first window, windows, the minimiser's first place and how many it has.

    grams[i] is the hash of the `gram` units from i on; offs are the rows' places in units. Windows stay within
    a row. The minimiser of a window is its gram of least hash, the leftmost of equal ones, so equal windows have
    equal minimisers. Where a gram repeats, windows of one least hash stay together, however many places it has.
    """
    units = int(offs[-1])
    if units < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    mask = np.uint64((1 << units.bit_length()) - 1)
    v = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(v, size - gram + 1) & mask).astype(np.int64)
    end = np.repeat(offs[1:], np.diff(offs))[: len(place)]
    first = np.flatnonzero(np.arange(size, size + len(place)) <= end)
    if not len(first):
        return first, first, first, first
    place = place[first]
    new = np.ones(len(first), bool)
    new[1:] = (grams[place[1:]] != grams[place[:-1]]) | (np.diff(first) != 1)
    at = np.flatnonzero(new)
    moved = np.ones(len(first), np.int64)
    moved[1:] = new[1:] | (place[1:] != place[:-1])
    return first[at], np.diff(at, append=len(first)), place[at], np.add.reduceat(moved, at)


def int64s(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark's signed ones, bit by bit."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
