"""Running numbers over whole tables without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, key: str, name: str = "place", digits: int = 3) -> DataFrame:
    """The rows with their places from 0 in the order of the key's MD5 and the key, which must be unique.

    Ranks within ranges of the hash, 16 ** digits in number, plus the sizes of the ranges before.
    """
    h = rows.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__part", F.substring("__h", 1, digits))
    sizes = h.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row a range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__h", key))
    placed = h.withColumn("__rank", rank).join(before, "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__h", "__part", "__rank", "__before")
