import numpy as np
import pytest

from loomset.llm import hard_negatives as hn
from loomset.llm import queries
from tests.oracle import assert_same

SCHEMA = "vec_id long, embedding array<double>, label int, norm string, row string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "n", "r", "s") for i, v, k in rows], SCHEMA)


def brute(rows, every, positives, negatives, least, most):
    sound = [(i, k, [int(np.floor(256 * c)) for c in v]) for i, v, k in rows if i is not None and k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, k, x in sound:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j, m) for j, m, y in sound if j != i)
        for s, p, _ in [r for r in scored if r[2] == k][:positives]:
            fit = [r for r in scored if r[2] != k and -least * s <= -100 * r[0] <= -most * s][:negatives]
            out += [(i, p, n + 1, j, -s, -r) for n, (r, j, _) in enumerate(fit)]
    return sorted(out)


def rows_of(seed, n=300, dims=5, spread=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dims) * (rng.exponential() * 3 if spread else 1)
        rows.append((i, (v if spread else v / np.linalg.norm(v)).round(1).tolist(), int(rng.integers(0, 3))))
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3) for i in range(120)]  # one common vector
    rows += [(2000, [0.0] * dims, 0), (2001, [1.0], 1), (2002, [], 2), (2003, None, 1), (2004, [1.0, None], 1), (2005, [float("inf")] * dims, 1), (2006, [float("nan")] * dims, 0), (2010, same, None), (None, same, 1), (21, same, 2), (20, same, 1)]
    return rows


@pytest.mark.parametrize(("seed", "spread", "block", "chunk"), [(1, True, 4096, 256), (2, True, 9, 4), (3, False, 16, 7)])
def test_equals_brute_force(spark, seed, spread, block, chunk):
    rows = rows_of(seed, spread=spread)
    got = hn.hard_negatives(frame(spark, rows), every=10, positives=3, negatives=4, block=block, chunk=chunk)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 3, 4, 30, 90)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 1e6 * rng.exponential()).tolist(), i % 2) for i in range(60)]
    assert sorted(map(tuple, hn.hard_negatives(frame(spark, rows), every=5).collect())) == brute(rows, 5, 5, 10, 30, 90)
    huge = hn.hard_negatives(frame(spark, [(i, [1e300, 1.0], i % 2) for i in range(8)]), every=4).collect()
    assert all(r.positive_score == (1 << 63) - 1 for r in huge)


def test_buckets_are_pruned(spark):
    rows = [(i, [float(10 ** (i % 4)), 1.0], i % 2) for i in range(400)]
    source = frame(spark, rows)
    blocks = hn.packed(source.select("vec_id", source["label"].cast("long").alias("label"), hn.whole(source["embedding"]).alias("x")).withColumn("norm", hn._norm(hn.F.col("x"))), 2, 20)
    norms = [r.norm for r in blocks.orderBy("bucket", "block").collect()]
    assert norms == sorted(norms, reverse=True) and len(norms) >= 20
    # an anchor that reaches the largest norms only keeps no row of a block below its limit
    x = np.array([[256, 0]])
    chunk = {"norms": np.array([256.0]), "rows": np.array([1]), "ids": np.array([-1]), "labels": np.array([0]), "x": x, "lows": np.array([[256 * 256 * 50]]), "highs": np.array([[1 << 62]])}
    small = {"norm": 2560.0, "ids": np.array([5]), "labels": np.array([1]), "x": np.array([[2560, 0]])}
    assert [len(c) for c in hn.best(chunk, small, 10, False)] == [0] * 4


def test_nothing_to_search(spark):
    assert hn.hard_negatives(frame(spark, [])).count() == 0
    assert hn.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert hn.hard_negatives(frame(spark, [(100, [1.0], 1)])).count() == 0
    assert hn.hard_negatives(frame(spark, [(100, [], 1), (1, [], 1), (2, [], 0)])).count() == 1


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(queries.op13_hard_negatives(spark, sf), sf, queries.ORACLE_SQL["op13_hard_negatives"])
