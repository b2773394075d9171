"""Reading items, and writing datasets in the usual training formats. Every writer works on partitions in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id string, project_id string, data_type string, source_url string, content string, file_path string, file_size long, metadata string, labels array<string>, quality_score double, created_at timestamp, dataset_split string"


def read_jsonl(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """Item rows from JSON lines; lines that don't parse give null columns."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content and size of files, a row each; Spark lists no empty ones."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content", F.col("length").alias("size"))


def json_lines(items: DataFrame, key: str, text: str, others: list[str]) -> DataFrame:
    """One JSON object per row in a column `value`: id, the other columns, text; absent fields are left out."""
    return items.select(F.to_json(F.struct(F.col(key).alias("id"), *others, F.col(text).alias("text"))).alias("value"))


def write_jsonl(items: DataFrame, path: str, key: str, text: str, others: list[str]) -> None:
    json_lines(items, key, text, others).write.text(path)


def csv_rows(items: DataFrame, key: str, text: str, labels: str) -> DataFrame:
    """Columns of a flat export: labels joined by a bar."""
    return items.select(F.col(key).cast("string").alias("id"), F.array_join(labels, "|").alias("labels"), F.col(text).alias("content"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_parquet(items: DataFrame, path: str, split: str | None = None) -> None:
    """Snappy Parquet, in a folder for each split if there is a split column."""
    writer = items.write.option("compression", "snappy")
    (writer.partitionBy(split) if split else writer).parquet(path)


def write_hub_dataset(items: DataFrame, path: str, key: str, text: str, split: str, others: list[str]) -> None:
    """`<path>/data/split=<name>/` of JSON lines and a one-line `<path>/dataset_info` with features and counts."""
    placed = items.withColumn("__split", F.coalesce(split, F.lit("train")))
    lines = placed.select("__split", F.to_json(F.struct(F.col(key).alias("id"), *others, F.col(text).alias("text"))).alias("value"))
    lines.withColumnRenamed("__split", "split").write.partitionBy("split").text(f"{path}/data")
    counts = placed.groupBy(F.col("__split").alias("split")).agg(F.count("*").alias("rows"))
    features = F.lit(",".join(["id", *others, "text"]))
    info = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "rows")))).alias("splits")).select(F.to_json(F.struct(features.alias("features"), "splits")).alias("value"))
    info.coalesce(1).write.text(f"{path}/dataset_info")


def coco_categories(boxes: DataFrame, label: str) -> DataFrame:
    """Categories numbered from 1 by name."""
    names = boxes.select(F.col(label).alias("name")).filter("name is not null").distinct()
    # places within ranges of the first two characters, and the names in the ranges before
    part = F.substring("name", 1, 2)
    sizes = names.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    ranked = names.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    return ranked.join(before, "part").select((F.col("before") + F.col("k")).alias("id"), "name")


def coco_annotations(boxes: DataFrame, image: str, label: str) -> DataFrame:
    """COCO annotation rows of boxes (image, label, x, y, width, height)."""
    cats = coco_categories(boxes, label)
    x = boxes.join(cats, boxes[label] == cats["name"])
    return x.select(F.col(image).alias("image_id"), F.col("id").alias("category_id"), F.array("x", "y", "width", "height").alias("bbox"), (F.col("width") * F.col("height")).alias("area"), F.lit(0).alias("iscrowd"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """GraphML edge elements, one per row."""

    def safe(c: str) -> Column:
        out = F.col(c)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return edges.select(F.concat(F.lit('<edge source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('"/>')).alias("value"))


def ply_lines(points: DataFrame) -> DataFrame:
    """Vertex lines of an ASCII PLY file: x y z with six decimals."""
    return points.select("cloud", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value"))
