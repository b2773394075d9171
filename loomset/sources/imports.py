"""Annotations read from other tools' files: XML elements of images and tracks, and JSON lines of labelled data rows.

Every annotation is a row. A document that doesn't parse, or an element of another kind, gives no rows; numbers that
are absent are 0, as are those that don't parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CVAT_IMAGE = "_id string, _name string, _width string, _height string, box array<struct<_label:string,_xtl:string,_ytl:string,_xbr:string,_ybr:string,_occluded:string>>, polygon array<struct<_label:string,_points:string>>"
CVAT_TRACK = "_id string, _label string, box array<struct<_frame:string,_xtl:string,_ytl:string,_xbr:string,_ybr:string,_outside:string,_occluded:string,_keyframe:string>>"
_VALUE = "bbox:struct<left:double,top:double,width:double,height:double>,polygon:array<struct<x:double,y:double>>,point:struct<x:double,y:double>,text:string"
LABELBOX = f"data_row struct<external_id:string,row_data:string>, metadata_fields array<struct<name:string,value:string>>, labels array<struct<name:string,value:struct<{_VALUE}>>>"


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def _flag(x: Column, none: int = 0) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(none)) != 0


def _extent(b: Column) -> list[Column]:
    return [_number(b["_xtl"]).alias("x"), _number(b["_ytl"]).alias("y"), (_number(b["_xbr"]) - _number(b["_xtl"])).alias("width"), (_number(b["_ybr"]) - _number(b["_ytl"])).alias("height")]


def point_list(text: Column) -> Column:
    """Pairs `x,y` parted by semicolons, as structs; others are left out."""
    pairs = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.split(p, ","))
    return F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(_number(p[0]).alias("x"), _number(p[1]).alias("y")))


def _shapes(image: Column) -> Column:
    """The boxes, then the polygons of an image element."""
    boxes = F.transform(F.coalesce(image["box"], F.expr("array()")), lambda b: F.struct(F.lit("box").alias("type"), b["_label"].alias("label"), *_extent(b), _flag(b["_occluded"]).alias("occluded"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("points")))
    none = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    polygons = F.transform(F.coalesce(image["polygon"], F.expr("array()")), lambda p: F.struct(F.lit("polygon").alias("type"), p["_label"].alias("label"), *none, F.lit(None).cast("boolean").alias("occluded"), point_list(p["_points"]).alias("points")))
    return F.concat(boxes, polygons)


def cvat_annotations(images: DataFrame) -> DataFrame:
    """image, name, image_width, image_height, place, type, label, x, y, width, height, occluded, points of each annotation of image elements (columns as in CVAT_IMAGE)."""
    x = images.select(F.struct("*").alias("i")).filter("i._id is not null or i._name is not null")
    each = x.select("i", F.posexplode(_shapes(F.col("i"))).alias("place", "a"))
    return each.select(F.col("i._id").alias("image"), F.col("i._name").alias("name"), _number(F.col("i._width")).cast("long").alias("image_width"), _number(F.col("i._height")).cast("long").alias("image_height"), "place", "a.*")


def cvat_frames(tracks: DataFrame) -> DataFrame:
    """track, label, frame, x, y, width, height, outside, occluded, keyframe of each box of track elements (columns as in CVAT_TRACK)."""
    x = tracks.filter("_id is not null").select(F.col("_id").alias("track"), F.col("_label").alias("label"), F.explode("box").alias("b"))
    b = F.col("b")
    return x.select("track", "label", _number(b["_frame"]).cast("long").alias("frame"), *_extent(b), _flag(b["_outside"]).alias("outside"), _flag(b["_occluded"]).alias("occluded"), _flag(b["_keyframe"], 1).alias("keyframe"))


def read_cvat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotations of images and frames of tracks of XML files, which Spark reads element by element, a large file in many tasks."""
    images, tracks = (spark.read.format("xml").option("rowTag", tag).schema(schema).load(path) for tag, schema in (("image", CVAT_IMAGE), ("track", CVAT_TRACK)))
    return cvat_annotations(images), cvat_frames(tracks)


def cvat_columns(elements: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """As read_cvat(), from a column with an image or a track element in each row."""
    v = F.col(value)
    images, tracks = (elements.filter(v.startswith(f"<{tag} ")).select(F.from_xml(v, schema).alias("e")).select("e.*") for tag, schema in (("image", CVAT_IMAGE), ("track", CVAT_TRACK)))
    return cvat_annotations(images), cvat_frames(tracks)


def labelbox_annotations(lines: DataFrame, value: str) -> DataFrame:
    """external_id, row_data, metadata, place, type (box, polygon, point or text), label, x, y, width, height, points, value of each label of data rows, one JSON object a line.

    A label is the first kind that it has; others are left out. A missing name is `unknown`.
    """
    x = lines.select(F.from_json(F.col(value), LABELBOX).alias("r")).select("r.*").filter("data_row is not null")
    metadata = F.map_from_entries(F.filter(F.coalesce("metadata_fields", F.expr("array()")), lambda f: f["name"].isNotNull()))
    each = x.select("data_row.*", metadata.alias("metadata"), F.posexplode("labels").alias("place", "l"))
    v = F.col("l.value")
    kind = F.when(v["bbox"].isNotNull(), "box").when(v["polygon"].isNotNull(), "polygon").when(v["point"].isNotNull(), "point").when(v["text"].isNotNull(), "text")
    size = {c: F.when(F.col("type") == "box", F.coalesce(v["bbox"][c], F.lit(0.0))) for c in ("width", "height")}
    at = {c: F.when(F.col("type") == "box", F.coalesce(v["bbox"][side], F.lit(0.0))).when(F.col("type") == "point", F.coalesce(v["point"][c], F.lit(0.0))) for c, side in (("x", "left"), ("y", "top"))}
    each = each.withColumn("type", kind).filter("type is not null")
    return each.select("external_id", "row_data", "metadata", "place", "type", F.coalesce("l.name", F.lit("unknown")).alias("label"), *(c.alias(k) for k, c in (at | size).items()), F.when(F.col("type") == "polygon", v["polygon"]).alias("points"), F.when(F.col("type") == "text", v["text"]).alias("value"))


def read_labelbox(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of files of JSON lines."""
    return labelbox_annotations(spark.read.text(path), "value")
