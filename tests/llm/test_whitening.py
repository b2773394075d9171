import numpy as np
import pytest

from loomset.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "n", "c") for i, v in rows], SCHEMA)


def brute(rows):
    """Rows that stay, and for each its x, by numpy's own eigenvectors."""
    keep = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in keep)
    keep = [(i, x + [0] * (width - len(x))) for i, x in keep]
    fit = sorted({tuple(x) for _, x in keep})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, float) - np.array([s / n for s in sums])
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    return keep, n, sums, e[::-1], v[:, ::-1].T, np.trace(cov)


@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_equals_numpy(spark, spread):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [spread, 3, 2, 1.5, 1, 0.1]).tolist()) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(60)] + [(0, rows[0][1]), (None, rows[3][1]), (200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("-inf")] + [0.0] * 5), (204, [-0.0] * 6), (205, [1.0, 2.0]), (206, [])]
    keep, n, sums, e, v, trace = brute(rows)
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 4 * len(keep)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    want = sorted((((i is None, i or 0), k + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), v[k] @ (np.array(x) - np.array(sums) / n) / np.sqrt(e[k]), e[k] / trace) for i, x in keep for k in range(4)), key=lambda r: (r[0], r[1], abs(r[3])))
    have = sorted((((r.vec_id is None, r.vec_id or 0), r.component, r.deviation, r.whitened, r.explained) for r in got), key=lambda r: (r[0], r[1], abs(r[3])))
    for a, b in zip(have, want, strict=True):
        assert a[:3] == b[:3] and abs(abs(a[3]) - abs(b[3])) < 1e-9 and abs(a[4] / b[4] - 1) < 1e-9
        if abs(b[3]) > 1e-6:
            assert signs.setdefault(a[1], np.sign(a[3] * b[3])) == np.sign(a[3] * b[3])


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    scale = np.logspace(0, -9, 12)
    b = rng.normal(size=(12, 12)) * 0.05
    core = np.eye(12) + (b + b.T) / 2
    a = scale[:, None] * core * scale[None, :]
    values, vectors = whitening.jacobi(a)
    # graded: the smallest eigenvalues are as exact as those of the core, scaled step by step
    assert (values > 0).all() and (np.diff(values) <= 0).all()
    assert abs(np.prod(values / scale**2) / np.linalg.det(core) - 1) < 1e-10
    assert np.abs(vectors @ vectors.T - np.eye(12)).max() < 1e-13


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.ones((4, 4)), np.diag([1.0, 5.0, 3.0]), np.zeros((0, 0))])
def test_jacobi_of_poor_matrices(a):
    values, vectors = whitening.jacobi(a)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-12) and np.allclose(vectors.T @ np.diag(values) @ vectors, a, atol=1e-12)


def test_no_spread_and_no_rows(spark):
    got = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert whitening.whitened(frame(spark, [])).count() == 0 == whitening.whitened(frame(spark, [(1, None)])).count()


def test_large_entries(spark):
    got = whitening.whitened(frame(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e30, 5.0])])).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)


def test_query(spark):
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.filter("identity_error > 1e-8 or whitened is null").count() == 0
