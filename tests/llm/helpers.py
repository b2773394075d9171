"""Fixtures of documents that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "null id"), (5, "x" * 300_000), (6, "ä ß 😀 é   wide\u0085next"), (7, "a\x00b \x1c c")]


def colliding(spark, tail):
    """Two texts with this end that a 32-bit hash can't tell apart."""
    from pyspark.sql import functions as F

    texts = spark.range(400_000).select(F.concat(F.format_string("%08X", "id"), F.lit(tail)).alias("t"))
    return sorted(texts.groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts")).filter(F.size("ts") > 1).first()["ts"])[:2]
