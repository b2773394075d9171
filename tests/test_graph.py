import random

from loomset.operators import graph
from loomset.operators.shared import written


def ranks(edges, rounds=100, damping=0.85):
    nodes = sorted({x for e in edges for x in e})
    out = {x: sum(s == x for s, _ in edges) for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        rank = {x: (1 - damping) / len(nodes) + damping * sum(rank[s] / out[s] for s, d in edges if d == x) for x in nodes}
    return rank


def test_pagerank_of_cycles_takes_the_hundred_rounds(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("d", "f")]
    got = {r.id: r.rank for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = ranks(edges)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)
    assert any(abs(ranks(edges, 10)[x] - want[x]) > 1e-4 for x in want)


def test_pagerank_after_few_rounds(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 9), rng.randint(5, 14)) for _ in range(30)] + [(20 + i, 30 + i % 2) for i in range(5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for rounds in (0, 1, 2, 3, 7):
        got = {r.id: r.rank for r in graph.pagerank(df, rounds).collect()}
        want = ranks(edges, rounds)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)
    assert graph.pagerank(df.limit(0)).count() == 0


def test_pagerank_carries_only_entered_nodes_and_ends_with_the_longest_way(spark, monkeypatch):
    edges = [(k, 1000 + k % 10) for k in range(100) for _ in range(1 + k % 3)] + [(1000 + k, 2000) for k in range(10)]
    sizes = []

    def counted(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    got = {r.id: r.rank for r in graph.pagerank(spark.createDataFrame([*edges, (5, None), (None, 1000)], "src long, dst long")).collect()}
    want = ranks([*edges, (5, 3000)])  # the null end is a node too
    want[None] = (1 - 0.85) / len(want)
    del want[3000]
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)
    assert sizes[:1] == [112] and max(sizes[1:]) <= 20 and len(sizes) <= 6


def ways_through(edges):
    """Betweenness by spelling out every shortest way, parallel edges apart."""
    ids = sorted({x for e in edges for x in e})
    after = {i: [d for s, d in edges if s == i and d != i] for i in ids}
    out = dict.fromkeys(ids, 0.0)
    for s in ids:
        ways, front, seen = {s: [[s]]}, [s], {s}
        while front:
            new = {}
            for v in front:
                for w in after[v]:
                    if w not in seen:
                        new.setdefault(w, []).extend([*p, w] for p in ways[v])
            ways |= new
            seen |= set(new)
            front = list(new)
        for t, all_ways in ways.items():
            for p in all_ways:
                for v in p[1:-1]:
                    out[v] += 1 / len(all_ways)
    n = len(ids)
    return {i: round(v / max((n - 1) * (n - 2), 1), 6) for i, v in out.items()}


def test_betweenness_equals_spelled_out_ways(spark):
    rng = random.Random(2)
    some = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(40)]
    hub = [(i, 100) for i in range(20)] + [(100, 200 + i) for i in range(20)] + [(200 + i, 300) for i in range(20)]
    for edges in (some + some[:5], hub, [(k, k + 1) for k in range(12)] + [(12, 0)], [(1, 1)], [(1, 2)]):
        got = graph.betweenness(spark.createDataFrame(edges, "src long, dst long")).collect()
        want = ways_through(edges)
        assert {r.id for r in got} == set(want) and all(abs(r.betweenness - want[r.id]) < 2e-6 for r in got)
    df = spark.createDataFrame(hub, "src long, dst long")
    one = {r.id: r.betweenness for r in graph.betweenness(df, spark.createDataFrame([(0,)], "id long")).collect()}
    assert one[100] > 0 and one[0] == 0 and sum(v > 0 for v in one.values()) == 21
    assert graph.betweenness(df.limit(0)).count() == 0


def test_hops_have_no_end(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(11)], "src long, dst long")
    assert {r.id: r.hops for r in graph.hops(df, 0).collect()} == {k: k for k in range(12)}
    assert {r.id for r in graph.hops(df, 0, 3).collect()} == {0, 1, 2, 3}
