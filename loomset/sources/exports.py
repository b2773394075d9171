"""Datasets in the forms of annotation tools, graph tools and point cloud tools: a row of text for each record.

Annotated items are rows (id, data_type, file_path, content, width, height, annotations); annotations is an array of
structs (type, label, x, y, width, height, points), points an array of structs (x, y). A null array is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.places import numbered

# The kinds that count as boxes, and media types of item kinds.
BOXES = ["box", "rectangle", "bounding_box"]
MEDIA_TYPES = {"image": "image/jpeg", "video": "video/mp4", "audio": "audio/mpeg"}


def escaped(x: Column) -> Column:
    """Text for XML content and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _annotations() -> Column:
    return F.coalesce(F.col("annotations"), F.array())


def media_type(data_type: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))[data_type]


def task_data(data_type: Column, file_path: Column, content: Column) -> Column:
    """An item's data under the name of its kind, as JSON."""
    own = F.when(data_type == "text", _text(content)).when(data_type.isin("image", "audio", "video"), _text(file_path)).otherwise(_text(F.coalesce(F.nullif(content, F.lit("")), file_path)))
    name = F.when(data_type.isin("image", "audio", "video", "text"), data_type).otherwise("data")
    return F.to_json(F.map_from_arrays(F.array(name), F.array(own)))


def studio_result(a: Column, key: Column) -> Column:
    """One annotation as a labelling result: boxes in hundredths, polygons as pairs, texts as choices; other kinds are null."""
    label = F.coalesce(a["label"], F.lit("unknown"))
    box, polygon = a["type"].isin(BOXES[:2]), a["type"] == "polygon"

    def part(c: str) -> Column:
        return F.when(box, a[c] / 100)

    value = F.struct(
        part("x").alias("x"), part("y").alias("y"), part("width").alias("width"), part("height").alias("height"), F.when(box, F.array(label)).alias("rectanglelabels"),
        F.when(polygon, F.transform(a["points"], lambda p: F.array(p["x"], p["y"]))).alias("points"), F.when(polygon, F.array(label)).alias("polygonlabels"),
        F.when(a["type"] == "text", F.array(label)).alias("choices"),
    )
    kind = F.when(box, "rectanglelabels").when(polygon, "polygonlabels").when(a["type"] == "text", "choices")
    text = kind == "choices"
    return F.when(kind.isNotNull(), F.struct(key.alias("id"), kind.alias("type"), F.when(text, "sentiment").otherwise("label").alias("from_name"), F.when(text, "text").otherwise("image").alias("to_name"), value.alias("value")))


def studio_tasks(items: DataFrame) -> DataFrame:
    """id and value: a labelling task with its data and one list of results, which is left out if the item has no annotations."""
    results = F.array_compact(F.transform(_annotations(), lambda a, i: studio_result(a, F.substring(F.md5(F.concat_ws(":", F.col("id"), i)), 1, 8))))
    done = F.when(F.size(_annotations()) > 0, F.array(F.struct(F.lit(1).alias("id"), F.lit(1).alias("completed_by"), results.alias("result")))).otherwise(F.array())
    value = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"data":'), task_data(F.col("data_type"), F.col("file_path"), F.col("content")), F.lit(',"annotations":'), F.to_json(done), F.lit(',"predictions":[]}'))
    return items.select("id", value.alias("value"))


def box_rows(items: DataFrame) -> DataFrame:
    """id and value: a data row with media attributes, metadata fields and labels, as one JSON line."""

    def label(a: Column, i: Column) -> Column:
        box, polygon = a["type"].isin(BOXES), a["type"] == "polygon"
        value = F.struct(
            F.when(box, F.struct(a["y"].alias("top"), a["x"].alias("left"), a["width"].alias("width"), a["height"].alias("height"))).alias("bbox"),
            F.when(polygon, a["points"]).alias("polygon"),
            F.when(a["type"] == "point", F.struct(a["x"].alias("x"), a["y"].alias("y"))).alias("point"),
            F.when(a["type"] == "classification", F.array(a["label"])).alias("checklist"),
            F.when(a["type"] == "text", a["label"]).alias("text"),
        )
        return F.struct(F.md5(F.concat_ws(":", F.col("id"), i)).alias("id"), F.coalesce(a["label"], F.lit("unknown")).alias("name"), value.alias("value"))

    attributes = F.struct(media_type(F.col("data_type")).alias("mimeType"), *(F.when(F.col("data_type") == "image", F.col(c)).alias(c) for c in ("width", "height")))
    fields = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("width", "height")))
    labels = F.when(F.size(_annotations()) > 0, F.transform(_annotations(), label))
    data = F.struct(F.col("id").cast("string").alias("external_id"), F.coalesce("file_path", "content", F.lit("")).alias("row_data"))
    return items.select("id", F.to_json(F.struct(data.alias("data_row"), attributes.alias("media_attributes"), fields.alias("metadata_fields"), labels.alias("labels"))).alias("value"))


def cvat_shape(a: Column) -> Column:
    """One annotation as an XML element; unknown kinds are empty."""
    label = escaped(F.coalesce(a["label"], F.lit("unknown")))
    corners = [F.lit('<box label="'), label, F.lit('" xtl="'), a["x"], F.lit('" ytl="'), a["y"], F.lit('" xbr="'), a["x"] + a["width"], F.lit('" ybr="'), a["y"] + a["height"], F.lit('" occluded="0"/>')]
    pairs = F.array_join(F.transform(a["points"], lambda p: F.concat_ws(",", p["x"], p["y"])), ";")
    line = F.concat(F.lit("<"), a["type"], F.lit(' label="'), label, F.lit('" points="'), pairs, F.lit('"/>'))
    return F.when(a["type"].isin(BOXES[:2]), F.concat(*corners)).when(a["type"].isin("polygon", "polyline", "points"), line).otherwise("")


def cvat_images(items: DataFrame) -> DataFrame:
    """id and value: the image element of each image, numbered from 0, and the track element of each video with a box for each annotation."""
    head = F.concat(F.lit('<image id="'), F.col("place"), F.lit('" name="'), escaped(_text(F.coalesce("file_path", F.concat(F.lit("image_"), "place")))), F.lit('" width="'), F.coalesce("width", F.lit(0)), F.lit('" height="'), F.coalesce("height", F.lit(0)), F.lit('">'))
    image = F.concat(head, F.array_join(F.transform(_annotations(), cvat_shape), ""), F.lit("</image>"))

    def frame(a: Column, i: Column) -> Column:
        return F.concat(F.lit('<box frame="'), i, F.lit('" xtl="'), a["x"], F.lit('" ytl="'), a["y"], F.lit('" xbr="'), a["x"] + a["width"], F.lit('" ybr="'), a["y"] + a["height"], F.lit('" outside="0"/>'))

    track = F.concat(F.lit('<track id="'), F.col("place"), F.lit('" label="'), escaped(F.coalesce(F.get(_annotations(), F.lit(0))["label"], F.lit("object"))), F.lit('">'), F.array_join(F.transform(_annotations(), frame), ""), F.lit("</track>"))
    rows = numbered(items.filter(F.col("data_type").isin("image", "video")), "id")
    return rows.select("id", F.when(F.col("data_type") == "image", image).otherwise(track).alias("value"))


def coco_labels(items: DataFrame) -> DataFrame:
    """name and category (from 1) in the order of the first item id and place that have the label."""
    seen = items.select("id", F.posexplode(_annotations()).alias("at", "a")).select(F.struct("id", "at").alias("first"), F.col("a.label").alias("name")).filter("name is not null")
    names = seen.groupBy("name").agg(F.min("first").alias("first"))  # one row a label
    ordered = names.agg(F.sort_array(F.collect_list(F.struct("first", "name"))).alias("all")).select(F.posexplode("all").alias("k", "x"))
    return ordered.select(F.col("x.name").alias("name"), (F.col("k") + 1).cast("long").alias("category"))


def coco_rows(items: DataFrame) -> DataFrame:
    """image_id, place, category_id, bbox, segmentation, area, iscrowd of each annotation that is a box or a polygon."""
    flat = items.select(F.col("id").alias("image_id"), F.posexplode(_annotations()).alias("place", "a")).filter(F.col("a.type").isin([*BOXES, "polygon"]))
    box = F.col("a.type") != "polygon"
    corners = F.when(box, F.array("a.x", "a.y", "a.width", "a.height"))
    outline = F.when(~box, F.flatten(F.transform("a.points", lambda p: F.array(p["x"], p["y"]))))
    found = flat.join(F.broadcast(coco_labels(items)), F.col("a.label") == F.col("name"), "left")  # one row a label
    area = F.when(box, F.col("a.width") * F.col("a.height")).otherwise(0)
    return found.select("image_id", "place", F.coalesce("category", F.lit(1)).alias("category_id"), corners.alias("bbox"), outline.alias("segmentation"), area.alias("area"), F.lit(0).alias("iscrowd"))


def packed_members(items: DataFrame, label: str) -> DataFrame:
    """name, content: the members of a tar of samples, eight digits and .json, .txt and .cls (the label, if any)."""
    rows = numbered(items, "id")
    stem = F.lpad(F.col("place").cast("string"), 8, "0")
    meta = F.to_json(F.struct("id", F.col("data_type").alias("type")))
    parts = F.array(F.struct(F.concat(stem, F.lit(".json")).alias("name"), meta.alias("content")), F.struct(F.concat(stem, F.lit(".txt")).alias("name"), F.col("content").alias("content")), F.struct(F.concat(stem, F.lit(".cls")).alias("name"), F.col(label).alias("content")))
    return rows.select(F.explode(F.filter(parts, lambda p: p["content"].isNotNull())).alias("p")).select("p.name", "p.content")


def gml_nodes(nodes: DataFrame) -> DataFrame:
    """id, number and value: node blocks of a GML file, numbered from 0."""
    return numbered(nodes, "id", "number").select("id", "number", F.format_string('  node [\n    id %d\n    label "%s"\n  ]', "number", F.col("id").cast("string")).alias("value"))


def gml_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst and value: edge blocks by the nodes' numbers; parallel edges stay."""
    n = numbered(nodes, "id", "number")
    a, b = n.select(F.col("id").alias("src"), F.col("number").alias("a")), n.select(F.col("id").alias("dst"), F.col("number").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.format_string("  edge [\n    source %d\n    target %d\n    weight 1.0\n  ]", "a", "b").alias("value"))


def link_rows(edges: DataFrame) -> DataFrame:
    """Links of a node-link JSON file."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1.0).alias("weight"))).alias("value"))


def element_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind and value: the node and edge elements of a network view."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.struct("id", F.col("id").alias("label")).alias("data"))).alias("value"))
    name = F.concat(F.lit("e"), F.md5(F.concat_ws(":", "src", "dst")))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.struct(name.alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1.0).alias("weight")).alias("data"))).alias("value"))
    return n.unionByName(e)


def pcd_lines(points: DataFrame) -> DataFrame:
    """cloud and value: data lines of an ASCII PCD file, colours packed into one number."""
    rgb = F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))
    return points.select("cloud", F.format_string("%.6f %.6f %.6f %d", "x", "y", "z", rgb).alias("value"))


def pcd_heads(points: DataFrame) -> DataFrame:
    """cloud and value: the head of each cloud's PCD file."""
    n = F.col("n").cast("string")
    head = F.concat(F.lit("# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH "), n, F.lit("\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS "), n, F.lit("\nDATA ascii"))
    return points.groupBy("cloud").agg(F.count("*").alias("n")).select("cloud", head.alias("value"))


def xyz_lines(points: DataFrame) -> DataFrame:
    return points.select("cloud", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value"))


def kitti_lines(boxes: DataFrame) -> DataFrame:
    """key and value: label lines of boxes (key, label, cx, cy, cz, length, width, height, turn)."""
    return boxes.select("key", F.concat(F.col("label"), F.lit(" 0 0 0 0 0 0 0 "), F.format_string("%.4f %.4f %.4f %.4f %.4f %.4f %.4f", "height", "width", "length", "cx", "cy", "cz", "turn")).alias("value"))


def clock(seconds: Column, mark: str) -> Column:
    """hh:mm:ss and, after the mark, milliseconds."""
    ms = F.floor(seconds * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.expr("0") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def subtitles(segments: DataFrame, group: str, place: str) -> DataFrame:
    """The group, srt and vtt: the lines of segments (start, end, text) in order, as subtitle files."""
    def timed(mark: str) -> Column:
        return F.concat(clock(F.col("start"), mark), F.lit(" --> "), clock(F.col("end"), mark), F.lit("\n"), F.trim("text"), F.lit("\n"))

    x = segments.select(group, F.col(place).alias("k"), timed(",").alias("s"), timed(".").alias("v"))
    all_ = x.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("k", "s", "v"))).alias("all"))
    srt = F.array_join(F.transform("all", lambda p, i: F.concat((i + 1).cast("string"), F.lit("\n"), p["s"])), "\n")
    vtt = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("all", lambda p: p["v"]), "\n"))
    return all_.select(group, srt.alias("srt"), vtt.alias("vtt"))


def card_yaml(counts: DataFrame, name: str) -> DataFrame:
    """value: the front matter of a dataset's card, from rows (split, rows), as one row."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "rows"))), lambda x: F.concat(F.lit("  - name: "), x["split"], F.lit("\n    num_examples: "), x["rows"])), "\n")
    return counts.agg(F.concat(F.lit(f"---\npretty_name: {name}\nsplits:\n"), lines, F.lit("\nsize: "), F.sum("rows"), F.lit("\n---\n")).alias("value"))
