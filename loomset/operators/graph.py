"""Graphs as an edge table (src, dst); parallel edges count, nodes come from the edges or a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.shared import discard, written


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and whole degree of each node; a loop counts once in the whole."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("d")).union(edges.select("dst", F.lit(0), F.lit(1), F.when(F.col("src") == F.col("dst"), 0).otherwise(1)))
    n = nodes_of(edges).agg(F.count("*").alias("n"))
    x = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("d").alias("degree"))
    return x.crossJoin(F.broadcast(n)).select("id", "out_degree", "in_degree", "degree", F.round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))  # one row


def basic_metrics(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density and degrees of a directed graph, as one row."""
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.round(F.avg("degree"), 4).alias("avg_degree"))
    x = d.crossJoin(e)  # one row each
    return x.withColumn("density", F.round(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6))


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85) -> DataFrame:
    """Ranks after so many rounds from 1 / n; the mass of nodes without out-edges is dropped.

    A node that no edge enters has its last rank after one round, so what all such nodes give is summed once; only
    edges from other nodes go through the rounds, parallel ones as one. A node that gets the same from all as the round
    before keeps its rank as it is, since a sum's last digits change with its order; rounds end early where all do.
    """
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(False).alias("entered")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), whole.alias("entered")))
    nodes = written(edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(F.sum("out").alias("out"), F.max("entered").alias("entered")))
    n = max(nodes.count(), 1)
    if rounds < 1:
        return nodes.select("id", F.round(F.lit(1.0 / n), 8).alias("rank"))
    least = (1 - damping) / n
    givers = nodes.select(F.col("id").alias("src"), "out", "entered")
    links = written(edges.filter(whole).join(givers, "src").groupBy("dst", F.when(F.col("entered"), F.col("src")).alias("src")).agg(F.sum(1 / F.col("out")).alias("w")))
    inner = links.filter("src is not null")
    still = F.coalesce(F.sum(F.when(F.col("src").isNull(), F.col("w"))), F.lit(0.0))
    ranks = written(links.groupBy(F.col("dst").alias("id")).agg(still.alias("still"), (F.lit(least) + damping * F.sum(F.col("w") / n)).alias("rank"), F.lit(True).alias("moved")))
    for k in range(2, rounds + 1):
        before = ranks
        gained = inner.join(before.select(F.col("id").alias("src"), "rank", "moved"), "src").groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("s"), F.max("moved").alias("met"))
        met = F.lit(True) if k == 2 else F.coalesce("met", F.lit(False))  # nodes that no edge enters change in the first round alone
        new = F.when(met, F.lit(least) + damping * (least * F.col("still") + F.coalesce("s", F.lit(0.0)))).otherwise(F.col("rank"))
        ranks = written(before.join(gained, before["id"] == gained["dst"], "left").select("id", "still", new.alias("rank"), (new != F.col("rank")).alias("moved")))
        discard(before)
        if ranks.filter("moved").isEmpty():
            break
    discard(links)
    return nodes.filter("not entered").select("id", F.lit(least).alias("rank")).union(ranks.select("id", "rank")).select("id", F.round("rank", 8).alias("rank"))


def hops(edges: DataFrame, start, most: int | None = None) -> DataFrame:
    """Fewest out-edges from a node to each node within reach, of so many or of any number."""
    seen = edges.sparkSession.createDataFrame([(start,)], f"id {edges.schema['src'].dataType.simpleString()}").withColumn("hops", F.lit(0))
    front, k = seen, 0
    while most is None or k < most:
        k += 1
        front = edges.join(front, edges["src"] == front["id"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def connected(edges: DataFrame) -> DataFrame:
    """id and component, the least id that is weakly connected, by labels that also jump to their labels' labels."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().checkpoint()
    labels = nodes_of(edges).withColumn("component", F.col("id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["src"], "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("j"))
        new = step.join(jump, "c").select("id", F.col("component").alias("old"), F.least("c", "j").alias("component")).checkpoint()
        labels = new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def neighbours(edges: DataFrame) -> DataFrame:
    """id and the ends of its out-edges in order; a parallel edge counts again."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def shortest_path(edges: DataFrame, start, end) -> DataFrame:
    """step and id along a shortest way by out-edges, of equal ways that by the least nodes; no rows if there is none.

    Fronts grow until one holds the end or is empty; each node keeps the least node before it.
    """
    kind = edges.schema["src"].dataType.simpleString()
    seen = edges.sparkSession.createDataFrame([(start, None)], f"id {kind}, before {kind}").withColumn("step", F.lit(0))
    front, step = seen, 0
    while front.filter(F.col("id") == end).isEmpty():
        step += 1
        met = edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("before"))
        front = met.join(seen.select("id"), "id", "left_anti").withColumn("step", F.lit(step)).checkpoint()
        if front.isEmpty():
            return seen.select("step", "id").limit(0)
        seen = seen.unionByName(front)
    way, at = [], end
    while at is not None:  # one row a step, as many as the way is long
        row = seen.filter(F.col("id") == at).first()
        way.append((row["step"], at))
        at = row["before"]
    return edges.sparkSession.createDataFrame(way[::-1], f"step int, id {kind}")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id and community: each node takes the label most frequent among its neighbours of either direction, the least of equal ones.

    All nodes change at once, up to so many rounds; a node keeps its label where that is as frequent as any.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("k")).checkpoint()
    labels = nodes_of(edges).withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("k").alias("k"))
        own = labels.withColumnsRenamed({"id": "src", "community": "own"})
        best = votes.join(own, "src").groupBy("src").agg(F.min(F.struct((-F.col("k")).alias("k"), (F.col("community") != F.col("own")).alias("other"), "community")).alias("b"))
        new = labels.join(best, labels["id"] == best["src"], "left").select("id", F.col("community").alias("old"), F.coalesce("b.community", "community").alias("community")).checkpoint()
        labels = new.select("id", "community")
        if new.filter("old <> community").isEmpty():
            break
    return labels


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """id and betweenness of each node: the share of shortest ways by out-edges between two others that lead through it, summed and divided by (n - 1) * (n - 2).

    Ways are counted level by level from all sources at once (or from the ids of `sources`, a stated set), a row for
    each source and node that it reaches; parallel edges make ways of their own, loops none. What lies behind a node
    is then handed back level by level. Each level is a join of written tables and a pre-aggregated sum.
    """
    links = written(edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("k")))
    nodes = written(nodes_of(edges))
    n = nodes.count()
    start = nodes if sources is None else nodes.join(sources.select("id"), "id", "left_semi")
    levels = [written(start.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("ways")))]
    seen = levels[0].select("source", "node")
    while True:
        ahead = levels[-1].join(links, F.col("node") == F.col("src")).groupBy("source", "dst").agg(F.sum(F.col("ways") * F.col("k")).alias("ways"))
        front = written(ahead.withColumnRenamed("dst", "node").join(seen, ["source", "node"], "left_anti"))
        if front.isEmpty():
            discard(front)
            break
        levels.append(front)
        seen = seen.unionByName(front.select("source", "node"))

    sums, behind = [], None
    for level, before in zip(levels[:0:-1], levels[-2::-1], strict=True):
        own = level.withColumn("share", F.lit(0.0)) if behind is None else level.join(behind, ["source", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        own = written(own)
        sums.append(own.select("node", "share"))
        back = own.withColumnRenamed("node", "dst").join(links, "dst").select("source", F.col("src").alias("node"), (F.col("k") / F.col("ways") * (1 + F.col("share"))).alias("part"))
        behind = back.join(before, ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("ways") * F.col("part")).alias("share"))
    total = nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("share"))
    for x in sums:
        total = total.unionByName(x)
    out = written(total.groupBy(F.col("node").alias("id")).agg(F.round(F.sum("share") / max((n - 1) * (n - 2), 1), 6).alias("betweenness")))
    discard(links, nodes, *levels)
    return out
