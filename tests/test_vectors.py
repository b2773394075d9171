import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.functions import vectors as V
from loomset.operators import curation, embeddings, neighbours

NAN, INF = float("nan"), float("inf")


def vectors(seed, n=150, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = [(i, (centres[i % 8] + rng.normal(size=d) * rng.choice([0.05, 0.3, 1])).round(3).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(2000, [c * 3 for c in rows[3][1]])]
    return rows + [(3000, None), (3001, []), (3002, [0.0] * d), (3003, [NAN] * d), (3004, [1.0] * (d - 1) + [None]), (3005, [INF] + [0.0] * (d - 1)), (None, rows[0][1]), (3006, [1e200] * d), (3007, [-0.0] * (d - 1) + [1.0]), (3008, [0.0] * (d - 1) + [2.0]), (3009, [1.0, 2.0]), (3010, [2.0, 4.1]), (5, rows[5][1])]


def sound(rows):
    return [(i, tuple(c + 0.0 for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]


def cosine(a, b):
    if len(a) != len(b):
        return -1
    p, q = (np.array(v) / np.abs(v).max() for v in (a, b))
    return float(p @ q / np.sqrt((p @ p) * (q @ q)))


@pytest.mark.parametrize(("threshold", "pivots", "block"), [(0.95, 64, 1024), (0.6, 7, 16), (0.99, 1, 8), (0.9, 200, 30)])
def test_similar_vectors_equal_brute_force(spark, threshold, pivots, block):
    rows = vectors(1)
    df = spark.createDataFrame(rows, "k long, v array<double>").selectExpr("k", "v", "1 AS id", "'x' AS side", "2 AS d", "3 AS cell")
    reps = {}
    for i, v in sound(rows):
        reps[v] = min(reps.get(v, i), i)
    want = sorted((a, b, round(cosine(v, w), 6)) for v, a in reps.items() for w, b in reps.items() if a < b and cosine(v, w) >= threshold)
    got = embeddings.similar_vectors(df, "k", "v", threshold, pivots=pivots, block=block).collect()
    assert len(want) > 20 and sorted((r.a, r.b) for r in got) == [w[:2] for w in want]
    assert all(abs(r.similarity - w[2]) < 2e-6 for r, w in zip(sorted(got, key=lambda r: (r.a, r.b)), want, strict=True))


def test_members_and_links(spark):
    rows = vectors(2)
    good = sound(rows)
    got = sorted(map(tuple, embeddings.linked(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 0.9).collect()))
    want = sorted((i, min(j for j, w in good if w == v), sum(w == v for _, w in good), sum(w == v or cosine(v, w) >= 0.9 for _, w in good) - 1) for i, v in good)
    assert got == want


def test_embedding_leakage(spark):
    rows = [(i, v, ("train", "val", "test", None)[i % 4 if i else 0] if i is not None else "train") for i, v in vectors(3)]
    df = spark.createDataFrame(rows, "k long, v array<double>, split string")
    reps = {}
    for i, v, s in rows:
        for j, w in sound([(i, v)]):
            if s:
                reps[s, w] = min(reps.get((s, w), j), j)
    want = sorted((a, s, b) for (r, v), a in reps.items() for (s, w), b in reps.items() if r == "train" != s and cosine(v, w) >= 0.95)
    got = embeddings.embedding_leakage(df, "k", "v", "split").collect()
    assert sorted((r.train_id, r.other, r.other_id) for r in got) == want and all((r.severity == "high") == (r.similarity > 0.99) for r in got)
    assert embeddings.embedding_leakage(df.limit(0), "k", "v", "split").count() == 0


def clouds(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in (("a", 150), ("b", 12), ("c", 11), ("d", 3), (None, 40)):
        rows += [(c, *rng.normal(size=3).round(2).tolist()) for _ in range(n)]
    rows += [("a", *(np.array([5, 5, 5]) + rng.normal(size=3) * 1e-4).tolist()) for _ in range(80)]  # a crowded cell
    rows += [("a", 0.5, 0.5, 0.5)] * 60 + [("e", 1.0, 1.0, 1.0)] * 20 + [("f", float(i // 2), 0.0, 0.0) for i in range(30)] + [("g", 1.0, 2.0, 3.0)]
    rows = [(c, i, x, y, z) for i, (c, x, y, z) in enumerate(rows)]
    return rows + [("a", None, 1.0, 1.0, 1.0), ("a", 9001, None, 1.0, 1.0), ("a", 9002, NAN, 1.0, 1.0), ("a", 9003, INF, 1.0, 1.0), ("d", 9004, -0.0, 0.0, 0.0), ("b", 150, *rows[150][2:])]


def around(rows, k):
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[2:])]
    out = []
    for n, (c, i, *p) in enumerate(good):
        away = sorted((math.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1]) + (q[2] - p[2]) * (q[2] - p[2])), j, *q) for m, (d, j, *q) in enumerate(good) if d == c and m != n)
        out.append((c, i, tuple(p), away[:k]))
    return out


@pytest.mark.parametrize("k", [10, 2])
def test_nearest_points_equal_brute_force(spark, k):
    rows = clouds(4)
    df = spark.createDataFrame(rows, "c string, id long, x double, y double, z double").selectExpr("c", "id", "x", "y", "z", "1 AS level", "2 AS place", "3 AS near")
    got = neighbours.nearest_points(df, "c", "id", k).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    have = sorted(((r.c, r.id, (r.x, r.y, r.z), [(n.away, n.id, n.x, n.y, n.z) for n in r.near]) for r in got), key=key)
    want = sorted(around(rows, k), key=key)
    assert [h[:3] for h in have] == [w[:3] for w in want]
    for h, w in zip(have, want, strict=True):
        assert [n[:2] for n in h[3]] == [n[:2] for n in w[3]], h[:3]


def test_normals_and_outliers(spark):
    rows = clouds(5)
    df = spark.createDataFrame(rows, "c string, id long, x double, y double, z double")
    lists = around(rows, 10)
    mean = {(c, i, p): sum(n[0] for n in near) / 10 for c, i, p, near in lists}
    few = {c for c, _, _, near in lists if len(near) < 9}
    by = {}
    for (c, _, _), m in mean.items():
        by.setdefault(c, []).append(m)
    got = neighbours.point_outliers(df, "c", "id").collect()
    assert len(got) == len(lists)
    for r in got:
        here = [m for (c, i, _), m in mean.items() if (c, i) == (r.c, r.id)]
        assert any(abs(r.mean_distance - m) < 1e-6 and r.outlier == (r.c not in few and m > np.mean(by[r.c]) + 2 * np.std(by[r.c])) for m in here)
    normals = neighbours.point_normals(df, "c", "id").collect()
    assert len(normals) == sum(len(near) >= 9 for *_, near in lists)
    assert all(abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-4 for r in normals)
    assert {(r.nx, r.ny, r.nz) for r in normals if r.c == "e"} == {(0.0, 0.0, 1.0)}
    assert neighbours.point_normals(df.limit(0), "c", "id").count() == 0


def test_vectors_are_not_repeated_by_cells(spark, monkeypatch):
    """Directions spread evenly near all planes between pivots: no table on the way holds one twice, and none is lost."""
    draw = np.random.default_rng(8)
    v = draw.normal(size=(400, 16))
    v[200:] = v[:200] + draw.normal(size=(200, 16)) * 0.1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    counts, plain = [], embeddings.written
    monkeypatch.setattr(embeddings, "written", lambda t: counts.append((out := plain(t)).count()) or out)
    got = {(r.a, r.b) for r in embeddings.similar_vectors(df, "k", "v", 0.9, pivots=8, block=50).collect()}
    assert max(counts) <= 400
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    good = unit @ unit.T >= 0.9
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if good[i, j]}
    new = {(r.a, r.b) for r in embeddings.similar_vectors(df, "k", "v", 0.9, F.when(F.col("k") < 100, 1).otherwise(0), pivots=8, block=50, fresh=True).collect()}
    assert {tuple(sorted(p)) for p in new} == {p for p in got if min(p) < 100}


def test_nearest_in_blocks_equals_every_pair(spark):
    """Ties, copies, other lengths and vectors without a direction included; the plan joins blocks, not rows."""
    rows = vectors(9)
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = curation.nearest(df, "k", "v", F.col("k") % 5 == 0, 4, block=32)
    q = df.filter("k % 5 = 0").select(F.col("k").alias("query"), F.col("v").alias("q"))
    every = df.crossJoin(q).filter("k <> query").select("query", "k", V.cosine(F.col("q"), F.col("v")).alias("s"))
    want = every.selectExpr("query", "k", "s", "row_number() OVER (PARTITION BY query ORDER BY s DESC, k) AS rank").filter("rank <= 4").select("query", "k", "rank", F.round("s", 5).alias("similarity"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_points_meet_lists_of_points(spark, monkeypatch):
    """With lists shorter than a cell's points the neighbours are those of all pairs, and no plan ranks pairs of points as rows."""
    from loomset.operators import neighbours

    plans, keep = [], neighbours.written

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(neighbours, "BLOCK", 3)
    monkeypatch.setattr(neighbours, "written", noted)
    draw = np.random.default_rng(4)
    rows = [(int(i % 2), i, *(float(x) for x in (draw.integers(0, 4, 3) if i < 40 else draw.normal(0, 1 + i % 3, 3)))) for i in range(120)]
    got = {r["id"]: [(n["id"], n["away"]) for n in r["near"]] for r in neighbours.nearest_points(spark.createDataFrame(rows, "cloud int, id long, x double, y double, z double"), "cloud", "id", 4).collect()}
    for c, i, *at in rows:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(at, other)))), j) for d, j, *other in rows if c == d and i != j)[:4]
        assert [j for j, _ in got[i]] == [j for _, j in near] and np.allclose([a for _, a in got[i]], [a for a, _ in near])
    assert plans and not any("windowspecdefinition(place" in p for p in plans)
