import base64
import hashlib
import io
import zipfile

import pytest

from loomset.llm import wacz


def reader(data):
    return lambda start, n: data[start : start + n]


def package(n=5, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(n):
            z.writestr(f"archive/{i}.bin", bytes([i]) * (100 + i))
        z.writestr("indexes/x.txt", b"text " * 50, zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"a comment"])
@pytest.mark.parametrize("big", [False, True])
def test_directories(monkeypatch, comment, big):
    if big:  # makes the writer use ZIP64 records for small files
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = package(comment=comment)
    assert (b"PK\x06\x06" in data) == big
    found = wacz.zip_directory(reader(data), len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(m.name, m.method, m.size, m.header) for m in found] == [(x.filename, x.compress_type, x.compress_size, x.header_offset) for x in z.infolist()]
        for m in found[:5]:
            at = wacz.member_start(reader(data), m)
            assert data[at : at + m.size] == z.read(m.name)


def test_broken_files():
    with pytest.raises(ValueError):
        wacz.zip_directory(reader(b"no zip"), 6)
    good = wacz.warc_record(1, "http://a", b"abc", wacz.bare_digest(b"abc"), None)
    assert wacz.parse_record(good).payload == b"abc"
    with pytest.raises(ValueError):
        wacz.parse_record(good.replace(b"abc", b"abd"))


SCHEMA = "page_id long, url string, html string, size long, path string, sha string, last long"


def test_archives_hold_every_page(spark):
    rows = [(1, "u1", "<p>é</p>"), (2, "u 2\r\n", "<p>é</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "x\r\n\r\ny" * 50_000), (6, "u6", "<p>é</p>"), (6, "u6", "<p>é</p>"), (None, "n", "alone"), (None, "n", "<p>é</p>")]
    df = spark.createDataFrame([(*r, 0, "p", "s", 1) for r in rows], SCHEMA)
    got = wacz.archived(df).collect()
    want = set()
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == raw and k is not None]
        last = max(same, default=None)
        kind = "revisit" if last is not None and i != last else "response"
        want.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, last if kind == "revisit" else None))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    assert len(got) == len(rows)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    none_smaller = wacz.archived(df, least=10).collect()
    assert {r.record_type for r in none_smaller if r.payload_bytes < 10} == {"response"}
    assert wacz.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_packages(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 40) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    made = wacz.write_wacz(wacz.with_revisits(df), f"file://{tmp_path}/w", package_bytes=2000)
    assert made.count() > 3
    assert sorted(r.page_id for r in wacz.read_wacz(made).collect()) == list(range(300))
