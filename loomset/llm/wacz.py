"""Web archives in ZIP packages (WACZ): written from pages, and read by range without unpacking.

A package is a ZIP file with stored members `archive/*.warc.gz`, whose records are compressed one by one, and an
index `indexes/index.cdx` that gives each record's member, offset and length. The reader parses the central
directory (and ZIP64's), finds the members' places, and reads single records by range.

Packages go to the shared folder through a filesystem that their URI names, so local paths, HDFS and object
stores work alike. A task that is run again writes packages of new names, and only those that its surviving run
reports are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import shared_dir, written

#: Compressed bytes after which a task starts another package.
PACKAGE_BYTES = 32 << 20
#: Bytes of a package that one reading task's share is reckoned in.
SHARE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with the payload, or, where refers_to is given, a revisit record without it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    """A record's fields; a response's payload is held against its digest. ValueError if it doesn't match."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    response = named["WARC-Type"] == "response"
    if response and (len(payload) != stated or bare_digest(payload) != digest):
        raise ValueError(f"{named['WARC-Record-ID']}: the payload doesn't match its digest")
    refers = named.get("WARC-Refers-To")
    return Record(_id(named["WARC-Record-ID"]), named["WARC-Target-URI"], named["WARC-Type"], _id(refers) if refers else None, stated, digest, payload if response else None)


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def zip_directory(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """Members of a ZIP file, from its central directory; read(start, length) gives bytes of the file."""
    tail = read(max(0, size - 22 - 65535), min(size, 22 + 65535))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - len(tail) + at
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and (locator := read(end - 20, 20))[:4] == b"PK\x06\x07":
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 directory isn't where its locator says")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = read(start, length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, whole = struct.unpack_from("<H8xII", raw, at + 10)
        n, extra, comment = struct.unpack_from("<HHH", raw, at + 28)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n].decode()
        x, stop = at + 46 + n, at + 46 + n + extra
        while x + 4 <= stop:
            kind, k = struct.unpack_from("<HH", raw, x)
            if kind == 1:  # 64-bit values, of those only that don't fit the fields above, in this order
                big = iter(struct.unpack_from(f"<{k // 8}Q", raw, x + 4))
                whole = next(big) if whole == 0xFFFFFFFF else whole
                packed = next(big) if packed == 0xFFFFFFFF else packed
                header = next(big) if header == 0xFFFFFFFF else header
            x += 4 + k
        out.append(Member(name, method, packed, header))
        at = stop + comment
    return out


def member_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a member's data begin, past its local header."""
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name}: no local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + extra


def record_places(read: Callable[[int, int], bytes], size: int) -> list[tuple[int, int]]:
    """Offset in the package and length of every record that its indexes list."""
    members = {m.name: m for m in zip_directory(read, size)}
    starts: dict[str, int] = {}
    out = []
    for name, m in members.items():
        if not re.match(r"indexes/.*\.cdxj?(\.gz)?$", name):
            continue
        raw = read(member_start(read, m), m.size)
        raw = zlib.decompress(raw, -15) if m.method == 8 else raw
        raw = gzip.decompress(raw) if name.endswith(".gz") else raw
        for line in raw.decode().splitlines():
            x = json.loads(line[line.index("{") :])
            at = f"archive/{x['filename']}"
            if at not in starts:
                if members[at].method:
                    raise ValueError(f"{at} is compressed: its records can't be read by range")
                starts[at] = member_start(read, members[at])
            out.append((starts[at] + int(x["offset"]), int(x["length"])))
    return out


def _package(records: list[tuple[str, bytes, str]]) -> bytes:
    """A WACZ file with one WARC member: (url, compressed record, digest) of each record."""
    index, at = [], 0
    for url, raw, digest in records:
        facts = {"url": url, "digest": f"sha1:{digest}", "filename": "data.warc.gz", "offset": str(at), "length": str(len(raw))}
        index.append(f"{url} 20240101000000 {json.dumps(facts, sort_keys=True)}\n")
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), b"".join(raw for _, raw, _ in records))
        z.writestr(zipfile.ZipInfo("indexes/index.cdx"), "".join(sorted(index)))
        z.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": len(records)}))
    return out.getvalue()


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads of at least so many bytes, the largest page_id (null: itself).

    Rows of that page_id are all responses, so repeated rows get the same result. A null page_id is the smallest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    # written first, so that Spark can split the partition of a payload that very many pages have
    copied = written(rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).filter("n > 1 and last is not null").select("sha", "last"))
    refers = (F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(copied, "sha", "left").select("page_id", "url", "html", F.when(F.col("last").isNotNull() & refers, F.col("last")).alias("refers_to"))


def write_wacz(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages of the rows of with_revisits(), written now; returns path and size of each."""
    where, top = fs.FileSystem.from_uri(folder)
    where.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        held: list[tuple[str, bytes, str]] = []

        def closed() -> pa.RecordBatch:
            data, path = _package(held), f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as f:
                f.write(data)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(data)], pa.int64())], ["path", "size"])

        size = 0
        for b in batches:
            for page_id, url, html, refers_to in zip(*b.columns, strict=True):
                payload, to, url = html.as_buffer().to_pybytes(), refers_to.as_py(), _clean(url.as_py())
                digest = bare_digest(payload)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                held.append((url, pack.compress(warc_record(page_id.as_py(), url, payload, digest, to)) + pack.flush(), digest))
                size += len(held[-1][1])
                if size >= package_bytes:
                    yield closed()
                    size = 0
        if held:
            yield closed()

    return written(pages.mapInArrow(run, "path string, size long"))


def read_wacz(packages: DataFrame) -> DataFrame:
    """Every record of the packages (path, size): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    One pass lists the places of the records; a second reads them by range, a large package in many tasks. A
    revisit's payload is null; its size and digest are those of the payload it refers to.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    found = record_places(lambda start, n, f=f: f.read_at(n, start), size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["path", "start", "length"])

    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for path, start, length in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    if path != opened:
                        if file:
                            file.close()
                        store, name = fs.FileSystem.from_uri(path)
                        opened, file = path, store.open_input_file(name)
                    out.append(parse_record(zlib.decompress(file.read_at(length, start), 31)))
                yield pa.RecordBatch.from_arrays([pa.array([getattr(r, k) for r in out], t) for k, t in types.items()], list(types))
        if file:
            file.close()

    listed = packages.select("path", "size").repartition("path").mapInArrow(places, "path string, start long, length long")
    shares = int((packages.agg(F.sum("size")).first()[0] or 0) / SHARE_BYTES) + 1
    dealt = listed.repartition(shares, "path", F.floor(F.col("start") / SHARE_BYTES)).sortWithinPartitions("path", "start")
    return dealt.mapInArrow(records, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written as packages into the shared folder, and read back."""
    return read_wacz(write_wacz(with_revisits(pages, least=least), f"{shared_dir(pages.sparkSession)}/wacz"))
