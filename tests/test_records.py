import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.sources import records as rec


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (rec.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert rec.crc32c(b"123456789") == 0xE3069283 and rec.crc32c(b"") == 0 and rec.crc32c(b"\x00" * 32) == 0x8A9136AA
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 4095, 4096, 4097, 4099, 9000):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert rec.crc32c(data) == slow_crc(data)


def test_frames_hold_and_break():
    whole = b"".join(map(rec.framed, [b"one", b"", b"x" * 5000]))
    assert list(rec.records_of(io.BytesIO(whole).read)) == [b"one", b"", b"x" * 5000]
    assert rec.framed(b"")[:8] == b"\0" * 8 and len(rec.framed(b"abc")) == 19
    for broken in (whole[:-1], whole[:5], whole[:14] + b"?" + whole[15:], b"\1" + whole[1:]):
        with pytest.raises(ValueError, match="broken"):
            list(rec.records_of(io.BytesIO(broken).read))


def test_examples_hold():
    facts = {"id": [b"7"], "text": ["é\n".encode()], "labels": [b"a", b"", b"c"], "q": [0.5, -2.0], "n": [0, 300, -1, 1 << 62], "none": []}
    assert rec.features_of(rec.example(facts)) == {k: v for k, v in facts.items() if v}
    # a known message: one feature "a" with the byte string "b"
    assert rec.example({"a": [b"b"]}).hex() == "0a0c0a0a0a0161" + "12050a030a0162" and rec.features_of(rec.example({})) == {}


def test_records_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    items = [(k, "text", "w" * (k * 37 % 900), ["a", f"l{k}"] if k % 3 else None, k / 4 if k % 2 else None) for k in range(300)] + [(None, None, None, [], None)]
    df = spark.createDataFrame(items, "id long, data_type string, content string, labels array<string>, quality_score double").repartition(3)
    rec.write_records(rec.item_examples(df), path, file_bytes=20_000)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    files = [n for n in names if n.startswith("part-")]
    assert len(files) > 3 and set(names) - set(files) - {f".{n}.crc" for n in files} == {"_SUCCESS"}
    assert all((tmp_path / "out" / n).stat().st_size < 22_000 for n in files)
    got = rec.example_items(rec.read_records(spark, path)).collect()
    want = [(str(i) if i is not None else "", k or "", t or None, n or [], q) for i, k, t, n, q in items]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with pytest.raises(Exception, match="holds files already"):
        rec.write_records(rec.item_examples(df), path)
    rec.write_records(rec.item_examples(df.limit(2)), path, overwrite=True)
    assert rec.read_records(spark, path).count() == 2
    rec.write_records(rec.item_examples(df.limit(0)), f"file://{tmp_path}/none")
    assert (tmp_path / "none" / "_SUCCESS").exists()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "failed"
    rows = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("record"))
    with pytest.raises(Exception, match="stop"):
        rec.write_records(rows, f"file://{path}", file_bytes=100)
    assert not path.exists() or not list(path.iterdir())


def test_tars_keep_samples_together(spark, tmp_path):
    members = [(f"{k:08d}.{end}", f"{end} {k} " * (k % 50)) for k in range(200) for end in ("json", "txt", "cls")] + [(None, "no name"), ("nodot", None), ("é/long" + "x" * 150 + ".txt", "deep")]
    rec.write_tars(spark.createDataFrame(members, "name string, content string"), f"file://{tmp_path}/t", file_bytes=30_000)
    shards = sorted((tmp_path / "t").glob("*.tar"))
    held = []
    for p in shards:
        with tarfile.open(p) as tar:
            held.append([(m.name, tar.extractfile(m).read().decode()) for m in tar])
    assert len(shards) > 4 and sorted(x for h in held for x in h) == sorted((n, t or "") for n, t in members if n)
    assert len({n.rpartition(".")[0] for h in held for n, _ in h}) == sum(len({n.rpartition(".")[0] for n, _ in h}) for h in held)
    got = rec.read_tars(spark, f"file://{tmp_path}/t").collect()
    assert sorted((r.name, r.content.decode()) for r in got) == sorted(x for h in held for x in h)
