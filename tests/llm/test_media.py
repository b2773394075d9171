import hashlib
import io
import zlib

import numpy as np
import pytest

from loomset.llm import media
from tests.llm.helpers import DOCS, ODD, docs


def test_round_trips():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (6, 5, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    text = b"P2 # a comment\n5 7 # another\n255\n" + " ".join(map(str, grey.reshape(-1))).encode()
    assert (media.decode(text) == grey).all()
    assert (media.decode(b"P1\n3 2\n101 010\n") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (media.decode(b"P5\n2 1\n65535\n" + b"\x00\x00\xff\xff") == [[0, 255]]).all()


def test_area_resize_against_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (10, 7)).astype(float)
    fine = np.repeat(np.repeat(x, 4, 0), 3, 1)  # 40 x 21: whole cells for 4 rows and 3 columns
    want = fine.reshape(4, 10, 3, 7).mean((1, 3))
    assert np.allclose(media.area_resize(x, 4, 3), want)


def test_media_columns(spark):
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    rows = [(1, media.encode_ppm(x), "w"), (2, None, "w"), (3, b"", "w"), (4, b"nonsense", "w"), (5, media.encode_bmp(x)[:60], "w"), (6, media.encode_bmp(x), "w")]
    got = {r.id: r for r in media.media_columns(spark.createDataFrame(rows, "id long, content binary, dhash string"), tile=2).collect()}
    assert got[1].dhash == got[6].dhash and got[1].error is None and got[1].channels == 3
    assert np.load(io.BytesIO(got[1].npy)).shape == (2, 2, 3)
    assert all(got[i].error and got[i].npy is None for i in (2, 3, 4, 5))


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577])
def test_payload(n):
    stored = media.store_payload(b"a" * n)
    pixels = media.decode(stored)
    assert pixels.size % 576 == 0 and pixels.size > 0 and pixels.tobytes() == b"a" * n + b"\xff" * (pixels.size - n) and pixels.size - n < 577


def test_query(spark):
    rows = [*ODD, (8, "same"), (9, "same")]
    got = media.digests(media.stored_text(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.store_payload(raw)).hexdigest() and r.media_bytes == len(media.store_payload(raw))
        assert r.tile_sha256 == hashlib.sha256(media.npy_tile(media.decode(media.store_payload(raw)), 32)).hexdigest()
    assert by[8].feature == by[9].feature
    assert media.digests(media.stored_text(spark.createDataFrame([], DOCS))).count() == 0
