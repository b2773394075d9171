"""Queries of near vectors and of neighbours of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import clustering, embeddings, neighbours
from loomset.plans.catalog import query, table

# Beside each vector, rounded ones of a third of them and scaled ones of a fifth, as a corpus embedded more than once has.
_NEAR = """near AS (
SELECT vec_id AS id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda c: floor(c::DOUBLE * 8) / 8) FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id + 2000000, list_transform(embedding, lambda c: c::DOUBLE * 2) FROM embeddings WHERE vec_id % 5 = 0
UNION ALL SELECT vec_id + 3000000, list_transform(embedding, lambda c: c::DOUBLE) FROM embeddings WHERE vec_id % 4 = 0)"""
_SPLIT = "CASE WHEN (id + id // 1000000 * 3) % 10 < 6 THEN 'train' WHEN id // 1000000 % 2 = 0 THEN 'val' ELSE 'test' END"


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rounded = e.filter("id % 3 = 0").select((F.col("id") + 1_000_000).alias("id"), F.transform("v", lambda c: F.floor(c * 8) / 8).alias("v"))
    scaled = e.filter("id % 5 = 0").select((F.col("id") + 2_000_000).alias("id"), F.transform("v", lambda c: c * 2).alias("v"))
    copies = e.filter("id % 4 = 0").select((F.col("id") + 3_000_000).alias("id"), "v")
    return e.unionByName(rounded).unionByName(scaled).unionByName(copies)


_CLASSES = f"""{_NEAR}, one AS (SELECT min(id) AS id, v, count(*) AS copies FROM near WHERE len(list_filter(v, lambda c: c <> 0)) > 0 GROUP BY v),
pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM one a JOIN one b ON a.id < b.id)"""


@query(f"WITH {_CLASSES} SELECT a, b, round(s, 6) AS similarity FROM pairs WHERE s >= 0.9::DOUBLE")
def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.similar_vectors(near_vectors(spark, sf_dir), "id", "v", 0.9).select("a", "b", "similarity")


@query(f"""WITH {_CLASSES}, good AS (SELECT a, b FROM pairs WHERE s >= 0.9::DOUBLE UNION ALL SELECT b, a FROM pairs WHERE s >= 0.9::DOUBLE),
others AS (SELECT a, sum(copies) AS others FROM good JOIN one ON one.id = good.b GROUP BY a)
SELECT near.id, one.id AS class_id, copies, (copies - 1 + coalesce(others, 0))::BIGINT AS n_links FROM near JOIN one USING (v) LEFT JOIN others ON others.a = one.id""".replace("SELECT near.id", "SELECT near.id AS id"))
def embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(near_vectors(spark, sf_dir), "id", "v", 0.9)


@query(f"""WITH {_NEAR}, sides AS (SELECT id, v, {_SPLIT} AS split FROM near), one AS (SELECT split, min(id) AS id, v FROM sides WHERE len(list_filter(v, lambda c: c <> 0)) > 0 GROUP BY split, v)
SELECT a.id AS train_id, b.split AS other, b.id AS other_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, CASE WHEN round(list_cosine_similarity(a.v, b.v), 6) > 0.99::DOUBLE THEN 'high' ELSE 'medium' END AS severity
FROM one a JOIN one b ON a.split = 'train' AND b.split <> 'train' WHERE list_cosine_similarity(a.v, b.v) >= 0.85::DOUBLE""")
def embedding_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = near_vectors(spark, sf_dir)
    split = F.when((F.col("id") + F.floor(F.col("id") / 1_000_000) * 3) % 10 < 6, "train").when(F.floor(F.col("id") / 1_000_000) % 2 == 0, "val").otherwise("test")
    return embeddings.embedding_leakage(i.withColumn("split", split), "id", "v", "split", 0.85)


def cloud_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("cloud"), F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))


_AROUND = """points AS (SELECT label AS cloud, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT a.cloud, a.id, a.x, a.y, a.z, b.id AS other, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
  sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS away FROM points a JOIN points b ON a.cloud = b.cloud AND a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY cloud, id ORDER BY away, other) AS rank FROM d QUALIFY rank <= 10)"""


@query(f"WITH {_AROUND} SELECT cloud, id, rank::INTEGER AS rank, other, round(away, 6) AS distance FROM near")
def point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours.nearest_points(cloud_points(spark, sf_dir), "cloud", "id", 10)
    n = n.select("cloud", "id", F.posexplode("near").alias("place", "n"))
    return n.select("cloud", "id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("other"), F.round("n.away", 6).alias("distance"))


@query(f"""WITH {_AROUND}, v AS (SELECT p.dy * q.dz - p.dz * q.dy AS nx, p.dz * q.dx - p.dx * q.dz AS ny, p.dx * q.dy - p.dy * q.dx AS nz, p.cloud, p.id
  FROM near p JOIN near q ON p.cloud = q.cloud AND p.id = q.id AND p.rank = 1 AND q.rank = 2),
l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM v)
SELECT cloud, id, CASE WHEN size > 0 THEN round(nx / size, 5) ELSE 0 END AS nx, CASE WHEN size > 0 THEN round(ny / size, 5) ELSE 0 END AS ny, CASE WHEN size > 0 THEN round(nz / size, 5) ELSE 1 END AS nz FROM l""")
def point_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.point_normals(cloud_points(spark, sf_dir), "cloud", "id")


@query(f"""WITH {_AROUND}, m AS (SELECT cloud, id, sum(away) / 10 AS mean FROM near GROUP BY 1, 2), t AS (SELECT cloud, avg(mean) + 2 * stddev_pop(mean) AS most FROM m GROUP BY 1)
SELECT cloud, id, round(mean, 6) AS mean_distance, mean > most AS outlier FROM m JOIN t USING (cloud)""")
def point_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.point_outliers(cloud_points(spark, sf_dir), "cloud", "id")


@query()
def vector_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.leader_clusters(near_vectors(spark, sf_dir), "id", "v", 0.85)


@query()
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.average_clusters(near_vectors(spark, sf_dir), "id", "v", 0.8, clustering.TASK_ROWS)


@query()
def vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 20).withColumn("distance", F.round("distance", 6))
