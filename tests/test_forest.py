import math

import numpy as np
import pytest

from loomset.operators import forest as f


def depth(tree, row):
    at = 0
    while tree[at][0] >= 0:
        at = tree[at][2] if row[tree[at][0]] <= tree[at][1] else tree[at][3]
    return tree[at][4]


def test_scores_equal_a_walk_of_each_tree():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(200, 3)), np.repeat(rng.normal(size=(1, 3)), 30, axis=0)])
    trees = [f.grown(x[rng.choice(len(x), 64, replace=False)], rng, 6) for _ in range(9)]
    got = f.scores_of(x, [tuple(np.array(c) for c in zip(*t, strict=True)) for t in trees], 64)
    c = 2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64
    want = [2 ** (-sum(depth(t, row) for t in trees) / 9 / c) for row in x]
    assert np.allclose(got, want) and all(left > at and right > at for t in trees for at, (k, _, left, right, _) in enumerate(t) if k >= 0)
    assert f.expected_depth(np.array([0, 1, 2, 256])).round(4).tolist() == [0, 0, 1, 10.2448]


def test_planted_rows_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(3000)]
    planted = [(9000 + i, *map(float, rng.normal(size=2) * 0.2 + [9, -9] * rng.choice([-1, 1], 2))) for i in range(30)]
    odd = [(None, 0.1, 0.2), (9990, None, 1.0), (9991, float("nan"), 1.0), (9992, 1.0, float("inf")), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows + planted + odd, "k long, a double, b double").selectExpr("k", "a", "b", "1 AS key", "2 AS x", "3 AS score")
    got = f.forest_anomalies(df, "k", ["a", "b"], share=0.02).collect()
    found = {r.k for r in got if r.anomaly}
    assert len(got) == len(rows + planted + odd) and {r.k for r in got if r.score is None} == {9990, 9991, 9992}
    assert len(found & {p[0] for p in planted}) == 30 and len(found) <= 0.02 * len(got) + 2
    assert len({r.score for r in got if r.k == 5}) == 1 and all(0 < r.score < 1 for r in got if r.score is not None)
    again = f.forest_anomalies(df.repartition(7), "k", ["a", "b"], share=0.02).collect()
    assert {(r.k, r.score) for r in again} == {(r.k, r.score) for r in got}


@pytest.mark.parametrize("rows", [[], [(1, 2.0)], [(1, 2.0), (2, 2.0)], [(1, None)]])
def test_nothing_to_part(spark, rows):
    got = f.forest_anomalies(spark.createDataFrame(rows, "k long, a double"), "k", ["a"]).collect()
    assert len(got) == len(rows) and not any(r.anomaly for r in got) and {r.score for r in got} <= {0.5, None}
