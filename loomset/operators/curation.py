"""Listing, labelling, versioning, retention and alignment of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomset.functions import vectors
from loomset.operators import pages as pages_of
from loomset.operators.shared import written


def page(items: DataFrame, where: Column, order: list, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of the rows that fit; the order must end in a unique key."""
    return items.filter(where).orderBy(*order).offset(skip).limit(limit)


def group_counts(items: DataFrame, group: str, kinds: dict[str, Column]) -> DataFrame:
    """Rows of each group, and those of each kind, in one pass."""
    return items.groupBy(group).agg(F.count("*").alias("items"), *(F.count_if(c).alias(k) for k, c in kinds.items()))


def relabelled(items: DataFrame, labels: str, mode: str, values: list[str]) -> DataFrame:
    """Labels added (once each), removed or replaced, and whether any is left."""
    given = F.array(*(F.lit(v) for v in values)).cast("array<string>")
    own = F.coalesce(F.col(labels), F.array().cast("array<string>"))
    new = {"add": F.array_union(own, given), "remove": F.array_except(own, given), "replace": given}[mode]
    return items.withColumn(labels, new).withColumn("is_labeled", F.size(labels) > 0)


def versions_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added and removed between two versions."""
    added = new.select(key).join(old.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(key).join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def expired(rows: DataFrame, group: str, time: str, key: str, now: Column, days: int = 30, newest: int = 5) -> DataFrame:
    """Rows older than so many days, or beyond the newest of their group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time), F.desc(key)))
    old = F.col(time) < now - F.make_dt_interval(F.lit(days))
    return rows.withColumn("rank", rank).filter(old | (F.col("rank") > newest)).select(key, group, "rank")


def queue_order(jobs: DataFrame, key: str, priority: str, time: str, top: int) -> DataFrame:
    """The next jobs: highest priority first, then oldest."""
    return jobs.orderBy(F.desc(priority), time, key).limit(top)


def cross_group_copies(items: DataFrame, key: str, group: str, content: str) -> DataFrame:
    """Items whose content an earlier item of another group has, with the first such item.

    Of each content the first two groups are kept in order of first appearance, so the join is one row to many.
    """
    x = items.select(key, group, F.md5(F.coalesce(F.lower(F.trim(content)), F.lit(""))).alias("hash"))
    first = x.groupBy("hash", group).agg(F.min(key).alias("first"))
    w = Window.partitionBy("hash").orderBy("first")
    two = first.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("hash").agg(
        F.min(F.when(F.col("k") == 1, F.struct("first", F.col(group).alias("g")))).alias("a"), F.min(F.when(F.col("k") == 2, F.struct("first", F.col(group).alias("g")))).alias("b")
    ).filter("b is not null")
    met = x.join(two, "hash").withColumn("other", F.when(F.col(group) != F.col("a.g"), F.col("a.first")).otherwise(F.col("b.first")))
    return met.filter(F.col("other") < F.col(key)).select(key, group, F.col("other").alias("duplicate_of"))


def first_copies(items: DataFrame, key: str, content: str) -> DataFrame:
    """Each item with the first item of the same content, itself included."""
    x = items.select(key, F.md5(F.coalesce(F.lower(F.trim(content)), F.lit(""))).alias("hash"))
    return x.join(x.groupBy("hash").agg(F.min(key).alias("first")), "hash").select(key, "first", (F.col(key) != F.col("first")).alias("is_duplicate"))


def nearest(vectors_: DataFrame, key: str, vector: str, queries: Column, k: int = 10, block: int = 8192) -> DataFrame:
    """For each stated query row, its k nearest other rows by cosine; queries are a stated set, met by all rows. Keys are whole numbers.

    Blocks of rows meet blocks of queries as matrices, and each gives k rows to a query; cosines of what may be among
    them are summed in the order of vectors.cosine(). Vectors that are null, empty or not finite, or of extreme size, take the plain way.
    """
    x = vectors_.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("key is not null")
    size = F.aggregate("v", F.lit(0.0), lambda n, c: n + c * c)
    x = written(x.withColumn("plain", F.coalesce((F.size("v") > 0) & (size < 1e200) & (size > 1e-200), F.lit(False))))

    def pack(group: pa.Table) -> pa.Table:
        x = np.asarray(group["v"].combine_chunks().flatten())
        return pa.table([group["d"].slice(0, 1), pa.array([np.asarray(group["key"], np.int64).tobytes()]), pa.array([np.ascontiguousarray(x).tobytes()])], ["d", "ids", "vs"])

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        rows = rows.withColumn("d", F.size("v"))
        n = rows.groupBy("d").agg(F.ceil(F.count("*") / size).alias("n"))
        packed = rows.join(F.broadcast(n), "d").select("d", "key", "v", F.pmod(F.xxhash64("key"), "n").alias("part")).groupBy("d", "part").applyInArrow(pack, "d int, ids binary, vs binary")
        return written(packed.toDF(f"d_{name}", f"ids_{name}", f"vs_{name}"))

    def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for c in range(a.shape[1]):
            total += a[:, c] * b[:, c]
        return total

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                (dp, p, x), (dq, q, y) = ((b.column(c)[row].as_py(), np.frombuffer(b.column(c + 1)[row].as_buffer(), np.int64), np.frombuffer(b.column(c + 2)[row].as_buffer(), np.float64)) for c in (0, 3))
                x, y = x.reshape(-1, dp), y.reshape(-1, dq)
                nx, ny = np.sqrt(in_order(x, x)), np.sqrt(in_order(y, y))
                for start in range(0, len(q), 256):
                    q_, y_, ny_ = q[start : start + 256], y[start : start + 256], ny[start : start + 256]
                    near = (y_ / ny_[:, None]) @ (x / nx[:, None]).T if dp == dq else np.zeros((len(q_), len(p)))
                    near[q_[:, None] == p] = -np.inf
                    least = np.partition(near, max(len(p) - k, 0), axis=1)[:, max(len(p) - k, 0)]
                    r, s = np.nonzero((near >= least[:, None] - 1e-9) & (near > -2))
                    score = in_order(y_[r], x[s]) / (ny_[r] * nx[s]) if dp == dq else np.zeros(len(r))
                    order = np.lexsort((p[s], -score, r))
                    r, s, score = r[order], s[order], score[order]
                    n = np.bincount(r, minlength=len(q_))
                    kept = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < k
                    yield pa.RecordBatch.from_arrays([pa.array(q_[r[kept]]), pa.array(p[s[kept]]), pa.array(score[kept])], ["query", "key", "s"])

    met = blocks(x.filter("plain"), block, "p").crossJoin(blocks(x.filter("plain and asks"), block // 8 or 1, "q")).mapInArrow(multiply, "query long, key long, s double")
    asked = x.filter("asks").select(F.col("key").alias("query"), F.col("v").alias("q"), F.col("plain").alias("sound"))
    odd = x.filter("not plain").drop("plain", "asks").crossJoin(asked.drop("sound")).unionByName(x.filter("plain").drop("plain", "asks").crossJoin(asked.filter("not sound").drop("sound")))
    met = met.unionByName(odd.filter(F.col("key") != F.col("query")).select("query", "key", vectors.cosine(F.col("q"), F.col("v")).alias("s")))
    order = Window.partitionBy("query").orderBy(F.desc("s"), "key")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", F.col("key").alias(key), "rank", F.round("s", 5).alias("similarity"))


def violations(items: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The names of the rules that a row breaks (a rule that is null is broken), joined by commas, for rows that break any."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))
    return items.select(key, F.array_join(broken, ",").alias("errors")).filter("errors <> ''")


def meta_tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Title, description, open-graph title, counts of links, images and headings, by patterns over whole pages."""
    h = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        key,
        F.trim(F.regexp_extract(h, r"(?i)<title[^>]*>([^<]*)", 1)).alias("title"),
        F.regexp_extract(h, r"(?i)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)", 1).alias("description"),
        F.regexp_count(h, F.lit(pages_of.ANCHOR)).cast("long").alias("links"),
        F.regexp_count(h, F.lit(r"(?i)<img[ />]")).cast("long").alias("images"),
        F.regexp_count(h, F.lit(r"(?i)<h[1-6][ >]")).cast("long").alias("headings"),
        F.regexp_count(h, F.lit(r"(?i)<p[ >]")).cast("long").alias("paragraphs"),
    )


def domain_counts(pages: DataFrame, url: str) -> DataFrame:
    """Pages of each network location, port and user included."""
    return pages.groupBy(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("domain")).agg(F.count("*").alias("pages"))


def with_share(counts: DataFrame, n: str) -> DataFrame:
    """Counts, which are few, with each one's share of their sum."""
    total = counts.agg(F.sum(n).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col(n) / F.col("total"), 6)).drop("total")


def member_groups(members: DataFrame, group: str, kind: str) -> DataFrame:
    """Each group's number of members, its kinds by name, and whether it has several."""
    return members.groupBy(group).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), (F.count_distinct(kind) > 1).alias("aligned"))


def group_coverage(members: DataFrame, group: str, kind: str) -> DataFrame:
    """Items of each kind, how many are in a group, and the share of those."""
    return members.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("items"), F.count(group).alias("grouped"), F.round(F.count(group) / F.count("*"), 6).alias("coverage"))


def state_counts(jobs: DataFrame, kind: str, state: str) -> DataFrame:
    """Jobs of each kind by state, and the state's share within the kind."""
    n = jobs.groupBy(F.col(kind).alias("kind"), F.col(state).alias("state")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))
