import json

from pyspark.sql import functions as F

from loomset.sources import exports, imports

XML = """<?xml version="1.0"?><annotations><version>1.1</version><meta><task><name>t</name></task></meta>
<image id="0" name="a &amp; b.jpg" width="10" height="20"><box label="cat" xtl="1" ytl="2.5" xbr="4" ybr="8" occluded="1"/><polygon label="dog" points="0,0;1.5,2;bad;3,4"/><box label="x"/></image>
<image id="1" name="none.jpg" width="no" height="5"/>
<track id="7" label="car"><box frame="3" xtl="0" ytl="0" xbr="5" ybr="6" outside="1" keyframe="0"/><box xtl="1" xbr="2"/></track></annotations>"""


def test_cvat_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text(XML.replace('id="0"', 'id="5"'))
    shapes, frames = imports.read_cvat(spark, str(tmp_path))
    got = sorted((r.image, r.place, r.type, r.label, r.x, r.y, r.width, r.height, r.occluded, [(p.x, p.y) for p in r.points or []], r["name"], r.image_width) for r in shapes.collect())
    one = [(0, "box", "cat", 1.0, 2.5, 3.0, 5.5, True, [], "a & b.jpg", 10), (1, "box", "x", 0.0, 0.0, 0.0, 0.0, False, [], "a & b.jpg", 10), (2, "polygon", "dog", None, None, None, None, None, [(0, 0), (1.5, 2), (3, 4)], "a & b.jpg", 10)]
    assert got == [(i, *r) for i in ("0", "5") for r in one]
    assert sorted(map(tuple, frames.distinct().collect())) == [("7", "car", 0, 1.0, 0.0, 1.0, 0.0, False, False, True), ("7", "car", 3, 0.0, 0.0, 5.0, 6.0, True, False, False)]


def test_broken_elements_give_no_rows(spark):
    rows = [("<image id='1' name='x'><box label='b' xtl='1'></image>",), (None,), ("",), ("<image ",), ("<track id='1'",), ('<image id="2" name="y" width="1" height="1"></image>',)]
    shapes, frames = imports.cvat_columns(spark.createDataFrame(rows, "v string"), "v")
    assert shapes.count() == 0 and frames.count() == 0


def test_labelbox_lines(spark, tmp_path):
    rows = [
        {"data_row": {"external_id": "1", "row_data": "a.jpg"}, "metadata_fields": [{"name": "w", "value": "3"}, {"value": "no name"}], "labels": [
            {"name": "cat", "value": {"bbox": {"left": 1, "top": 2, "width": 3}}}, {"value": {"polygon": [{"x": 0, "y": 1}]}}, {"name": "p", "value": {"point": {"x": 5, "y": 6.5}}},
            {"name": "t", "value": {"text": "says"}}, {"name": "odd", "value": {"mask": 1}}, {"name": "none"}]},
        {"data_row": {"external_id": "2"}, "labels": []}, {"labels": [{"name": "x"}]},
    ]
    (tmp_path / "a.ndjson").write_text("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    got = sorted((r.external_id, r.place, r.type, r.label, r.x, r.y, r.width, r.height, [(p.x, p.y) for p in r.points or []], r.value, r.metadata) for r in imports.read_labelbox(spark, str(tmp_path)).collect())
    assert got == [
        ("1", 0, "box", "cat", 1.0, 2.0, 3.0, 0.0, [], None, {"w": "3"}), ("1", 1, "polygon", "unknown", None, None, None, None, [(0.0, 1.0)], None, {"w": "3"}),
        ("1", 2, "point", "p", 5.0, 6.5, None, None, [], None, {"w": "3"}), ("1", 3, "text", "t", None, None, None, None, [], "says", {"w": "3"}),
    ]


def test_tracks_come_back(spark):
    shape = "type string, label string, x long, y long, width long, height long, points array<struct<x:long,y:long>>"
    rows = [(1, "video", "v.mp4", None, 8, 9, [("box", 'a "b"', 1, 2, 3, 4, None), ("box", "c", 5, 6, 7, 8, None)]), (2, "video", None, None, None, None, None)]
    items = spark.createDataFrame(rows, f"id long, data_type string, file_path string, content string, width long, height long, annotations array<struct<{', '.join(c.replace(' ', ':', 1) for c in shape.split(', '))}>>")
    _, frames = imports.cvat_columns(exports.cvat_images(items), "value")
    assert sorted((r.label, r.frame, r.x, r.y, r.width, r.height, r.outside, r.keyframe) for r in frames.collect()) == [('a "b"', 0, 1.0, 2.0, 3.0, 4.0, False, True), ('a "b"', 1, 5.0, 6.0, 7.0, 8.0, False, True)]
    assert frames.select(F.countDistinct("track")).first()[0] == 1
