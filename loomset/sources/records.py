"""Record files: framed records with checksums, and tar shards of samples, written by a data source that commits.

Tasks write files of bounded size under a folder of the job's own beside the data. Only the driver's commit moves them
to their names, so readers see a task's files once, or not at all: what failed, repeated or was left by lost executors
stays in the job's folder, which commit and abort delete. A path that holds data is refused unless it is overwritten;
then the old files go when the new ones are there.

Folders are any that pyarrow's file systems open and the cluster shares. Records are framed as eight bytes of length
(little-endian), four of checksum, the record, and four of its checksum: CRC-32C, turned and shifted.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes after which a file is closed and another begun.
FILE_BYTES = 128 << 20

# The reversed polynomial of CRC-32C, and the number that framed records add to their turned checksums.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_BLOCK = 4096
_tables: list[np.ndarray] = []


def _effects() -> np.ndarray:
    """What each byte does to the checksum when so many zero bytes follow it, by their number and the byte."""
    if not _tables:
        first = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1)
        out = np.empty((_BLOCK, 256), np.uint32)
        out[0] = first
        for k in range(1, _BLOCK):
            out[k] = (out[k - 1] >> 8) ^ first[out[k - 1] & 0xFF]
        _tables.append(out)
    return _tables[0]


def crc32c(data: bytes) -> int:
    """CRC-32C; the checksum is linear, so a block's is the sum of what each of its bytes does."""
    table, state = _effects(), 0xFFFFFFFF
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), _BLOCK):
        block = view[at : at + _BLOCK].copy()
        if len(block) < 4:
            for byte in block.tolist():
                state = (state >> 8) ^ int(table[0][(state ^ byte) & 0xFF])
            continue
        block[:4] ^= np.frombuffer(state.to_bytes(4, "little"), np.uint8)
        state = int(np.bitwise_xor.reduce(table[np.arange(len(block) - 1, -1, -1), block]))
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(record: bytes) -> bytes:
    size = len(record).to_bytes(8, "little")
    return size + masked(crc32c(size)).to_bytes(4, "little") + record + masked(crc32c(record)).to_bytes(4, "little")


def records_of(read) -> Iterator[bytes]:
    """The records of a file, given what reads its next bytes; ValueError where one is cut short or its checksum is wrong."""
    while head := read(12):
        size = int.from_bytes(head[:8], "little")
        if len(head) < 12 or masked(crc32c(head[:8])) != int.from_bytes(head[8:], "little"):
            raise ValueError("a record's length is broken")
        body = read(size + 4)
        if len(body) < size + 4 or masked(crc32c(body[:size])) != int.from_bytes(body[size:], "little"):
            raise ValueError("a record is broken")
        yield body[:size]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Writes the rows' files into the job's folder; a kind of file adds `close` and its own `add`."""

    def __init__(self, folder: str, overwrite: bool, suffix: str, file_bytes: int):
        self.folder, self.overwrite, self.suffix, self.file_bytes = folder.rstrip("/"), overwrite, suffix, file_bytes
        self.pending = f"{self.folder}/_pending-{uuid.uuid4().hex}"
        if not overwrite and self._data():
            raise ValueError(f"{self.folder} holds files already")

    def _data(self) -> list[str]:
        store, base = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [f.path for f in found if not f.base_name.startswith(("_", "."))]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.pending)
        store.create_dir(base, recursive=True)
        files, out, at = [], None, 0
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and at >= self.file_bytes and self.may_cut(row):
                    self.close(out)
                    out = None
                if out is None:
                    files.append(f"{base}/{uuid.uuid4().hex}{self.suffix}")
                    out, at = self.opened(store.open_output_stream(files[-1])), 0
                at += self.add(out, row)
        if out is not None:
            self.close(out)
        return Written(files)

    def commit(self, messages: list) -> None:
        store, base = fs.FileSystem.from_uri(self.folder)
        old = self._data() if self.overwrite else []
        store.create_dir(base, recursive=True)
        for k, path in enumerate(p for m in messages if m is not None for p in m.files):
            store.move(path, f"{base}/part-{k:05d}-{uuid.uuid4().hex[:8]}{self.suffix}")
        for path in old:
            store.delete_file(path)
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, base = fs.FileSystem.from_uri(self.pending)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)

    def may_cut(self, row: tuple) -> bool:
        return True


class _RecordWriter(_Writer):
    def opened(self, stream):
        return stream

    def add(self, out, row: tuple) -> int:
        data = framed(row[0] if row[0] is not None else b"")
        out.write(data)
        return len(data)

    def close(self, out) -> None:
        out.close()


class _TarWriter(_Writer):
    """Members of one sample (the name up to its last dot) stay in one shard, as far as their rows follow each other."""

    def opened(self, stream):
        self.stream, self.stem = stream, None
        return tarfile.open(fileobj=stream, mode="w|", format=tarfile.PAX_FORMAT)

    def add(self, out, row: tuple) -> int:
        name, content = row[0], row[1] if row[1] is not None else b""
        info = tarfile.TarInfo(name)
        info.size = len(content)
        out.addfile(info, io.BytesIO(content))
        self.stem = name.rpartition(".")[0]
        return 512 + -(-len(content) // 512) * 512

    def may_cut(self, row: tuple) -> bool:
        return row[0].rpartition(".")[0] != self.stem

    def close(self, out) -> None:
        out.close()
        self.stream.close()


class Records(DataSource):
    """Rows (record binary) as files of framed records. Options: path, fileBytes."""

    suffix, made = ".tfrecord", _RecordWriter

    @classmethod
    def name(cls) -> str:
        return "framed_records"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return self.made(self.options["path"], overwrite, self.suffix, int(self.options.get("fileBytes", FILE_BYTES)))


class TarShards(Records):
    """Rows (name string, content binary) as tar files; the rows of one name's stem must follow each other in a partition."""

    suffix, made = ".tar", _TarWriter

    @classmethod
    def name(cls) -> str:
        return "tar_shards"


def _written(rows: DataFrame, kind: type[Records], path: str, overwrite: bool, file_bytes: int) -> None:
    rows.sparkSession.dataSource.register(kind)
    rows.write.format(kind.name()).option("path", path).option("fileBytes", str(file_bytes)).mode("overwrite" if overwrite else "append").save()


def write_records(rows: DataFrame, path: str, record: str = "record", overwrite: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """The rows' bytes (null: empty) as files of framed records."""
    _written(rows.select(F.col(record).cast("binary").alias("record")), Records, path, overwrite, file_bytes)


def write_tars(members: DataFrame, path: str, overwrite: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Members (name, content) as tar shards, the members of one sample side by side in one shard; rows without a name are left out."""
    m = members.filter("name is not null").select("name", F.col("content").cast("binary").alias("content"))
    stem = F.regexp_extract("name", r"(?s)^(.*)\.", 1)
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _written(m.repartitionByRange(parts, stem).sortWithinPartitions(stem, "name"), TarShards, path, overwrite, file_bytes)


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path of each file, a partition for each few of them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")  # names only: the content isn't read
    return found.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 0) and record of every framed record; a broken one fails the read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_stream(at) as f:
                    for n, record in enumerate(records_of(f.read)):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([record], pa.binary())], ["file", "n", "record"])

    return _files(spark, path, Records.suffix).mapInArrow(read, "file string, n long, record binary")


def read_tars(spark: SparkSession, path: str) -> DataFrame:
    """file, name and content of every member of the tar files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_stream(at) as f, tarfile.open(fileobj=f, mode="r|") as tar:
                    for member in tar:
                        if member.isfile():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member.name]), pa.array([tar.extractfile(member).read()], pa.binary())], ["file", "name", "content"])

    return _files(spark, path, TarShards.suffix).mapInArrow(read, "file string, name string, content binary")


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def example(features: dict[str, list]) -> bytes:
    """A serialised example: features by name, each a list of byte strings (1), floats (2) or whole numbers (3); empty ones are left out."""
    out = b""
    for name, values in sorted(features.items()):
        if not values:
            continue
        if isinstance(values[0], bytes):
            kind, data = 1, b"".join(_field(1, v) for v in values)
        elif isinstance(values[0], float):
            kind, data = 2, _field(1, np.array(values, "<f4").tobytes())
        else:
            kind, data = 3, _field(1, b"".join(map(_varint, values)))
        out += _field(1, _field(1, name.encode()) + _field(2, _field(kind, data)))
    return _field(1, out)


def _fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            n |= (data[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 0x80:
                return n

    at = 0
    while at < len(data):
        key = number()
        if key & 7 != 2:
            raise ValueError("not an example")
        size = number()
        yield key >> 3, data[at : at + size]
        at += size


def features_of(data: bytes) -> dict[str, list]:
    """The features of an example() by name."""
    out: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            for kind, values in _fields(parts.get(2, b"")):
                if kind == 1:
                    out[parts[1].decode()] = [v for _, v in _fields(values)]
                    continue
                packed = b"".join(v for _, v in _fields(values))
                out[parts[1].decode()] = np.frombuffer(packed, "<f4").tolist() if kind == 2 else _numbers(packed)
    return out


def _numbers(packed: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in packed:
        n, shift = n | (byte & 0x7F) << shift, shift + 7
        if byte < 0x80:
            out.append(n - (1 << 64) if n >> 63 else n)
            n = shift = 0
    return out


def item_examples(items: DataFrame) -> DataFrame:
    """record: an example of each item (id, data_type, content, labels, quality_score), with its text, first label, labels and score where it has them."""
    x = items.select(F.col("id").cast("string"), "data_type", "content", "labels", F.col("quality_score").cast("double").alias("quality_score"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, kind, text, labels, quality in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names = [n.encode() for n in labels or [] if n is not None]
                out.append(example({"id": [(key or "").encode()], "type": [(kind or "").encode()], "text": [text.encode()] if text else [], "label": names[:1], "labels": names, "quality_score": [] if quality is None else [quality]}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return x.mapInArrow(make, "record binary")


def example_items(records: DataFrame) -> DataFrame:
    """id, data_type, content, labels and quality_score of records as item_examples() makes them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features_of(r) for r in b.column(0).to_pylist()]
            text = lambda f, name: f[name][0].decode() if f.get(name) else None
            cols = [[text(f, name) for f in found] for name in ("id", "type", "text")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([[n.decode() for n in f.get("labels", [])] for f in found], pa.list_(pa.string())), pa.array([f.get("quality_score", [None])[0] for f in found], pa.float64())], ["id", "data_type", "content", "labels", "quality_score"])

    return records.select("record").mapInArrow(read, "id string, data_type string, content string, labels array<string>, quality_score double")
