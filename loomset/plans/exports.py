"""Queries of the export forms. Annotated items are parts, whose order lines stand for boxes and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import graph
from loomset.plans.catalog import EDGES, ORACLE_SQL, POINTS, SPLIT, cloud, edges, items, query, table
from loomset.operators import splits
from loomset.operators.shared import shared_dir
from loomset.sources import exports, imports, records

ITEMS = """a AS (SELECT l_partkey AS id, l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linestatus = 'O' THEN 'box' ELSE 'polygon' END AS type, l_returnflag AS label,
(l_linenumber * 3)::BIGINT AS x, (l_linenumber * 2)::BIGINT AS y, floor(l_quantity)::BIGINT AS w, floor(l_quantity / 2)::BIGINT AS h FROM lineitem),
ann AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, n, type, label, x, y, w, h) - 1 AS place FROM a),
items AS (SELECT p_partkey AS id, p_name || '.jpg' AS file_path, p_size::BIGINT * 10 AS width, p_size::BIGINT * 5 AS height FROM part)"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images; an item's annotations are those of one part, in the order of their lines."""
    x, y, w, h = F.col("l_linenumber") * 3, F.col("l_linenumber") * 2, F.floor("l_quantity"), F.floor(F.col("l_quantity") / 2)
    x, y = x.cast("long"), y.cast("long")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    one = F.struct(F.when(F.col("l_linestatus") == "O", "box").otherwise("polygon").alias("type"), F.col("l_returnflag").alias("label"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), F.array(corner(x, y), corner(x + w, y), corner(x, y + h)).alias("points"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", one.alias("a")))), lambda s: s["a"]).alias("annotations"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("image").alias("data_type"), F.concat("p_name", F.lit(".jpg")).alias("file_path"), F.lit(None).cast("string").alias("content"), (F.col("p_size").cast("long") * 10).alias("width"), (F.col("p_size").cast("long") * 5).alias("height"))
    return p.join(lines, "id", "left")


_POLY = "'[[' || x || ',' || y || '],[' || (x + w) || ',' || y || '],[' || x || ',' || (y + h) || ']]'"


@query(f"""WITH {ITEMS}, r AS (SELECT id, string_agg('{{"id":"' || substring(md5(id || ':' || place), 1, 8) || '","type":"' || CASE WHEN type = 'box' THEN 'rectanglelabels' ELSE 'polygonlabels' END || '","from_name":"label","to_name":"image","value":{{' ||
CASE WHEN type = 'box' THEN '"x":' || (x / 100)::DOUBLE || ',"y":' || (y / 100)::DOUBLE || ',"width":' || (w / 100)::DOUBLE || ',"height":' || (h / 100)::DOUBLE || ',"rectanglelabels":["' || label || '"]' ELSE '"points":' || {_POLY} || ',"polygonlabels":["' || label || '"]' END || '}}}}', ',' ORDER BY place) AS r FROM ann GROUP BY 1)
SELECT id, '{{"id":' || id || ',"data":' || '{{"image":' || to_json(file_path)::VARCHAR || '}},"annotations":' || CASE WHEN r IS NULL THEN '[]' ELSE '[{{"id":1,"completed_by":1,"result":[' || r || ']}}]' END || ',"predictions":[]}}' AS value FROM items LEFT JOIN r USING (id)""")
def studio_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.studio_tasks(annotated(spark, sf_dir))


@query(f"""WITH {ITEMS}, r AS (SELECT id, string_agg('{{"id":"' || md5(id || ':' || place) || '","name":"' || label || '","value":{{' || CASE WHEN type = 'box' THEN '"bbox":{{"top":' || y || ',"left":' || x || ',"width":' || w || ',"height":' || h || '}}'
ELSE '"polygon":[{{"x":' || x || ',"y":' || y || '}},{{"x":' || (x + w) || ',"y":' || y || '}},{{"x":' || x || ',"y":' || (y + h) || '}}]' END || '}}}}', ',' ORDER BY place) AS r FROM ann GROUP BY 1)
SELECT id, '{{"data_row":{{"external_id":"' || id || '","row_data":' || to_json(file_path)::VARCHAR || '}},"media_attributes":{{"mimeType":"image/jpeg","width":' || width || ',"height":' || height || '}},"metadata_fields":[{{"name":"width","value":"' || width || '"}},{{"name":"height","value":"' || height || '"}}]' || coalesce(',"labels":[' || r || ']', '') || '}}' AS value FROM items LEFT JOIN r USING (id)""")
def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.box_rows(annotated(spark, sf_dir))


@query(f"""WITH {ITEMS}, r AS (SELECT id, string_agg(CASE WHEN type = 'box' THEN '<box label="' || label || '" xtl="' || x || '" ytl="' || y || '" xbr="' || (x + w) || '" ybr="' || (y + h) || '" occluded="0"/>'
ELSE '<polygon label="' || label || '" points="' || x || ',' || y || ';' || (x + w) || ',' || y || ';' || x || ',' || (y + h) || '"/>' END, '' ORDER BY place) AS r FROM ann GROUP BY 1)
SELECT id, '<image id="' || (row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1) || '" name="' || file_path || '" width="' || width || '" height="' || height || '">' || coalesce(r, '') || '</image>' AS value FROM items LEFT JOIN r USING (id)""")
def cvat_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.cvat_images(annotated(spark, sf_dir))


@query(f"""WITH {ITEMS}, f AS (SELECT label, min((id, place)) AS first FROM ann JOIN items USING (id) GROUP BY 1), c AS (SELECT label, row_number() OVER (ORDER BY first) AS category FROM f)
SELECT id AS image_id, place::INT AS place, category AS category_id, CASE WHEN type = 'box' THEN x || ',' || y || ',' || w || ',' || h END AS bbox, CASE WHEN type <> 'box' THEN x || ',' || y || ',' || (x + w) || ',' || y || ',' || x || ',' || (y + h) END AS segmentation,
CASE WHEN type = 'box' THEN w * h ELSE 0 END AS area, 0 AS iscrowd FROM ann JOIN items USING (id) JOIN c USING (label)""")
def coco_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.coco_rows(annotated(spark, sf_dir)).withColumns({c: F.array_join(c, ",") for c in ("bbox", "segmentation")})


@query(f"""WITH {SPLIT}, i AS (SELECT d.doc_id AS id, d.text, d.lang, row_number() OVER (ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS place FROM documents d), n AS (SELECT *, lpad(place::VARCHAR, 8, '0') AS stem FROM i)
SELECT stem || '.json' AS name, '{{"id":' || id || ',"type":"text"}}' AS content FROM n UNION ALL SELECT stem || '.txt', text FROM n WHERE text IS NOT NULL UNION ALL SELECT stem || '.cls', lang FROM n WHERE lang IS NOT NULL""")
def packed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("data_type"), F.col("text").alias("content"), "lang")
    return exports.packed_members(d, "lang")


_NODES = f"{EDGES}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), n AS (SELECT id, row_number() OVER (ORDER BY md5(id), id) - 1 AS number FROM v)"


@query(f"""WITH {_NODES} SELECT id, number, '  node [' || chr(10) || '    id ' || number || chr(10) || '    label "' || id || '"' || chr(10) || '  ]' AS value FROM n""")
def gml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.gml_nodes(graph.nodes_of(edges(spark, sf_dir)))


@query(f"""WITH {_NODES} SELECT src, dst, '  edge [' || chr(10) || '    source ' || a.number || chr(10) || '    target ' || b.number || chr(10) || '    weight 1.0' || chr(10) || '  ]' AS value FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst""")
def gml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return exports.gml_edges(e, graph.nodes_of(e))


@query(f"""WITH {EDGES} SELECT '{{"source":"' || src || '","target":"' || dst || '","weight":1.0}}' AS value FROM edges""")
def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.link_rows(edges(spark, sf_dir))


@query(f"""WITH {_NODES} SELECT 'node' AS kind, '{{"data":{{"id":"' || id || '","label":"' || id || '"}}}}' AS value FROM v UNION ALL SELECT 'edge', '{{"data":{{"id":"e' || md5(src || ':' || dst) || '","source":"' || src || '","target":"' || dst || '","weight":1.0}}}}' FROM edges""")
def element_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return exports.element_rows(e, graph.nodes_of(e))


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).withColumns({"r": F.pmod("cloud", F.lit(256)).cast("int"), "g": F.lit(7), "b": F.lit(200)})


@query(f"WITH {POINTS} SELECT cloud, printf('%.6f %.6f %.6f %d', x, y, z, ((cloud % 256) << 16) | (7 << 8) | 200) AS value FROM points")
def pcd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.pcd_lines(coloured(spark, sf_dir))


@query(f"""WITH {POINTS}, n AS (SELECT cloud, count(*) AS n FROM points GROUP BY 1)
SELECT cloud, replace('# .PCD v0.7 - Point Cloud Data file format|VERSION 0.7|FIELDS x y z rgb|SIZE 4 4 4 4|TYPE F F F U|COUNT 1 1 1 1|WIDTH ' || n || '|HEIGHT 1|VIEWPOINT 0 0 0 1 0 0 0|POINTS ' || n || '|DATA ascii', '|', chr(10)) AS value FROM n""")
def pcd_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.pcd_heads(cloud(spark, sf_dir))


@query(f"WITH {POINTS} SELECT cloud, printf('%.6f %.6f %.6f', x, y, z) AS value FROM points")
def xyz_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.xyz_lines(cloud(spark, sf_dir))


_BOXES = "b AS (SELECT p_partkey AS key, p_brand AS label, p_size::DOUBLE AS cx, p_size / 2.0::DOUBLE AS cy, 0.5::DOUBLE AS cz, p_size::DOUBLE AS length, 2.0::DOUBLE AS width, 1.5::DOUBLE AS height, (p_size % 7) / 4.0::DOUBLE AS turn FROM part)"


def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("label"), s.alias("cx"), (s / 2).alias("cy"), F.lit(0.5).alias("cz"), s.alias("length"), F.lit(2.0).alias("width"), F.lit(1.5).alias("height"), (s % 7 / 4).alias("turn"))


@query(f"WITH {_BOXES} SELECT key, label || ' 0 0 0 0 0 0 0 ' || printf('%.4f %.4f %.4f %.4f %.4f %.4f %.4f', height, width, length, cx, cy, cz, turn) AS value FROM b")
def kitti_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.kitti_lines(turned_boxes(spark, sf_dir))


@query(f"""WITH {_BOXES}, s AS (SELECT * FROM (VALUES (-1), (1)) a(sx), (VALUES (-1), (1)) b(sy), (VALUES (-1), (1)) c(sz))
SELECT key, round(cx + sx * length / 2 * cos(turn) - sy * width / 2 * sin(turn), 6) AS x, round(cy + sx * length / 2 * sin(turn) + sy * width / 2 * cos(turn), 6) AS y, round(cz + sz * height / 2, 6) AS z, round(length * width * height, 6) AS volume,
round(sqrt(pow(sx * length / 2, 2) + pow(sy * width / 2, 2) + pow(sz * height / 2, 2)), 6) AS distance FROM b, s""")
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomset.operators import points

    return points.box_corners(turned_boxes(spark, sf_dir), "key")


def _clock(s: str, mark: str) -> str:
    return f"(lpad((floor({s} / 3600)::INT)::VARCHAR, 2, '0') || ':' || lpad((floor({s} / 60)::INT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({s})::INT % 60)::VARCHAR, 2, '0') || '{mark}' || lpad((({s} * 1000)::BIGINT % 1000)::VARCHAR, 3, '0'))"


@query(f"""WITH t AS (SELECT conv_id, turn, trim(text) AS text, turn * 1.5::DOUBLE AS a, turn * 1.5::DOUBLE + 1.25 AS b FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t)
SELECT conv_id, string_agg(k || chr(10) || {_clock('a', ',')} || ' --> ' || {_clock('b', ',')} || chr(10) || text || chr(10), chr(10) ORDER BY k) AS srt,
'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('a', '.')} || ' --> ' || {_clock('b', '.')} || chr(10) || text || chr(10), chr(10) ORDER BY k) AS vtt FROM n GROUP BY 1""")
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("conv_id is not null and text is not null").withColumns({"start": F.col("turn") * 1.5, "end": F.col("turn") * 1.5 + 1.25})
    return exports.subtitles(t, "conv_id", "turn")


@query(f"""WITH {SPLIT}, c AS (SELECT split, count(*) AS n FROM split GROUP BY 1) SELECT '---' || chr(10) || 'pretty_name: documents' || chr(10) || 'splits:' || chr(10) || string_agg('  - name: ' || split || chr(10) || '    num_examples: ' || n, chr(10) ORDER BY split) || chr(10) || 'size: ' || sum(n) || chr(10) || '---' || chr(10) AS value FROM c""")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = splits.auto_split(table(spark, sf_dir, "documents"), "doc_id")
    return exports.card_yaml(s.groupBy("split").agg(F.count("*").alias("rows")), "documents")


_CORNERS = "CASE WHEN type <> 'box' THEN concat(x, ',', y, ';', x + w, ',', y, ';', x, ',', y + h) END AS points"


def _flat(annotations: DataFrame) -> DataFrame:
    """Points as one string of whole numbers, other numbers whole too."""
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(",", p["x"].cast("long"), p["y"].cast("long"))), ";")
    return annotations.withColumns({"points": points} | {c: F.col(c).cast("long") for c in ("x", "y", "width", "height")})


@query(f"""WITH {ITEMS} SELECT file_path AS name, items.width AS image_width, items.height AS image_height, type, label, CASE WHEN type = 'box' THEN x END AS x, CASE WHEN type = 'box' THEN y END AS y,
CASE WHEN type = 'box' THEN w END AS width, CASE WHEN type = 'box' THEN h END AS height, {_CORNERS} FROM ann JOIN items USING (id)""")
def cvat_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, _ = imports.cvat_columns(exports.cvat_images(annotated(spark, sf_dir)), "value")
    return _flat(images).drop("image", "place", "occluded")


@query(f"""WITH {ITEMS} SELECT id::VARCHAR AS external_id, file_path AS row_data, items.width::VARCHAR AS meta_width, place::INTEGER AS place, type, label, CASE WHEN type = 'box' THEN x END AS x, CASE WHEN type = 'box' THEN y END AS y,
CASE WHEN type = 'box' THEN w END AS width, CASE WHEN type = 'box' THEN h END AS height, {_CORNERS} FROM ann JOIN items USING (id)""")
def labelbox_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imports.labelbox_annotations(exports.box_rows(annotated(spark, sf_dir)), "value")
    return _flat(rows.withColumn("meta_width", F.col("metadata")["width"]).drop("metadata", "value"))


@query("""SELECT doc_id::VARCHAR AS id, 'text' AS data_type, md5(coalesce(text, '')) AS content, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS labels, (n_chars % 64) / 64 AS quality_score
FROM documents LEFT JOIN labels USING (doc_id)""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as framed examples into the shared folder, and read back."""
    d = items(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("text").alias("data_type"), F.col("text").alias("content"), "labels", (F.col("n_chars") % 64 / 64).alias("quality_score"))
    path = f"{_uri(shared_dir(spark))}/records"
    records.write_records(records.item_examples(d), path, file_bytes=8 << 20)
    back = records.example_items(records.read_records(spark, path))
    return back.withColumns({"content": F.md5(F.coalesce("content", F.lit(""))), "labels": F.array_join("labels", ",")})


def _uri(path: str) -> str:
    return path if ":/" in path else f"file://{path}"


@query(ORACLE_SQL["packed_members"].replace("SELECT stem || '.json' AS name", "SELECT name, md5(content) AS content FROM (SELECT stem || '.json' AS name") + ")")
def tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of packed_members() written as tar shards into the shared folder, and read back."""
    path = f"{_uri(shared_dir(spark))}/tars"
    records.write_tars(packed_members(spark, sf_dir), path, file_bytes=8 << 20)
    return records.read_tars(spark, path).select("name", F.md5("content").alias("content"))
