import json

from loomset.sources import files

ROWS = [(1, 'a "q", b\nc', ["x", "y"], "train", "en"), (2, None, None, "test", None), (3, "é", [], None, "fa"), (4, "", ["z"], "train", "en")]
SCHEMA = "doc long, body string, labels array<string>, split string, lang string"


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write_jsonl(df, f"{tmp_path}/j", "doc", "body", ["lang"])
    lines = [json.loads(line) for p in sorted((tmp_path / "j").glob("part-*")) for line in p.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["id"]) == [{k: v for k, v in (("id", i), ("lang", g), ("text", t)) if v is not None} for i, t, _, _, g in ROWS]
    back = files.read_jsonl(spark, f"{tmp_path}/j", "id long, lang string, text string")
    assert sorted((r.id, r.lang, r.text) for r in back.filter("id <> 2").collect()) == [(i, g, t) for i, t, _, _, g in ROWS if i != 2]
    (tmp_path / "j" / "broken.json").write_text("{oops\n")
    assert files.read_jsonl(spark, f"{tmp_path}/j", "id long, text string").filter("id is null").count() == 1


def test_csv_and_binary(spark, tmp_path):
    rows = files.csv_rows(spark.createDataFrame(ROWS, SCHEMA), "doc", "body", "labels")
    files.write_csv(rows, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", "id string, labels string, content string").collect()
    assert sorted((r.id, r.labels or "", r.content or "") for r in back) == [(str(i), "|".join(n or []), t or "") for i, t, n, _, _ in ROWS]
    (tmp_path / "b" / "deep").mkdir(parents=True)
    for name, data in (("a.bin", b"\x00\xff"), ("deep/c.bin", b"1"), ("empty.bin", b""), ("no.txt", b"x")):
        (tmp_path / "b" / name).write_bytes(data)
    got = files.read_binary(spark, f"{tmp_path}/b", "*.bin").collect()
    assert sorted((r.path.rpartition("/")[2], bytes(r.content), r["size"]) for r in got) == [("a.bin", b"\x00\xff", 2), ("c.bin", b"1", 1)]


def test_parquet_and_hub_folders(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write_parquet(df, f"{tmp_path}/p", "split")
    assert spark.read.parquet(f"{tmp_path}/p/split=train").count() == 2
    files.write_hub_dataset(df, f"{tmp_path}/h", "doc", "body", "split", ["lang"])
    assert sorted(p.name for p in (tmp_path / "h" / "data").iterdir() if p.is_dir()) == ["split=test", "split=train"]
    info = json.loads(next((tmp_path / "h" / "dataset_info").glob("part-*")).read_text())
    assert info == {"features": "id,lang,text", "splits": {"test": 1, "train": 3}}


def test_categories_are_numbered_by_name(spark):
    names = ["b", "a", "ab", "abc", "é", "b", None, "z" * 40, "", "aa"]
    got = files.coco_categories(spark.createDataFrame([(n,) for n in names], "label string"), "label").collect()
    assert [(r.id, r.name) for r in sorted(got, key=lambda r: r.id)] == list(enumerate(sorted({n for n in names if n is not None}), 1))
