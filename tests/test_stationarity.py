"""Tests of series against plain numpy over whole series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from loomset.operators import stationarity as st

START = datetime(2024, 1, 1)


def made(kind, n, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    if kind == "walk":
        return np.cumsum(e) + 1e6
    if kind == "ar":
        v = np.zeros(n)
        for t in range(1, n):
            v[t] = 0.5 * v[t - 1] + e[t]
        return v
    if kind == "trend":
        return 0.05 * np.arange(n) + e
    return np.sin(np.arange(n) / 5) + 0.3 * e


SERIES = {"walk": made("walk", 700, 1), "ar": made("ar", 900, 2), "trend": made("trend", 333, 3), "wave": made("wave", 500, 4), None: made("ar", 120, 5), "short": np.arange(3.0), "one": np.array([1.0]), "flat": np.full(50, 2.0), "few": made("ar", 13, 6)}


def frame(spark, series=SERIES):
    rows = [(s, START + timedelta(hours=t), 0, float(v)) for s, vs in series.items() for t, v in enumerate(vs)]
    rows += [("ar", START + timedelta(hours=7), 1, None), ("ar", START + timedelta(hours=9), 1, float("nan")), ("wave", START, 1, float("inf"))]
    df = spark.createDataFrame(rows, "s string, at timestamp, no int, value double")
    return df.selectExpr("s", "at", "no", "value", "1 AS i", "2 AS k", "3 AS v", "4 AS n", "5 AS b", "6 AS lags")


@pytest.fixture(autouse=True, params=[64, 4096])
def block(request, monkeypatch):
    monkeypatch.setattr(st, "BLOCK", request.param)


def dickey_fuller(x):
    def regress(lags, skip):
        d = np.diff(x)
        t = np.arange(skip + 1, len(x))
        z = np.column_stack([np.ones(len(t)), x[t - 1] - x.mean(), *(d[t - 1 - k] for k in range(1, lags + 1))])
        beta, *_ = np.linalg.lstsq(z, d[t - 1], rcond=None)
        left = ((d[t - 1] - z @ beta) ** 2).sum()
        return left, beta, z

    most = min(len(x) // 2 - 2, math.ceil(12 * (len(x) / 100) ** 0.25))
    scores = []
    for lags in range(most + 1):
        left, _, z = regress(lags, most)
        scores.append((len(z) * (math.log(2 * math.pi * left / len(z)) + 1) + 2 * z.shape[1], lags))
    lags = min(scores)[1]
    left, beta, z = regress(lags, lags)
    return beta[1] / math.sqrt(left / (len(z) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1]), lags, len(z)


def test_adf_equals_least_squares(spark):
    got = {r.s: r for r in st.adf(frame(spark), "s", ["at", "no"], "value").collect()}
    assert set(got) == set(SERIES)
    for s, x in SERIES.items():
        if s in ("short", "one", "flat"):
            assert got[s].statistic is None and got[s].stationary is None
            continue
        t, lags, n = dickey_fuller(x)
        assert (got[s].lags, got[s].observations) == (lags, n) and abs(got[s].statistic - t) < 2e-4, s
        assert abs(got[s].p_value - st.adf_p(t)) < 1e-5 and got[s].stationary == (st.adf_p(t) < 0.05)
    assert got["ar"].stationary and not got["walk"].stationary
    assert abs(got["ar"].critical_5 - (-2.86154 - 2.8903 / got["ar"].observations)) < 1e-3


def test_published_p_values():
    # the tabled critical values of long series stand for their levels
    for p, t in ((0.01, -3.43), (0.05, -2.86), (0.10, -2.57)):
        assert abs(st.adf_p(t) - p) < 0.003
    assert st.adf_p(-50.0) == 0 and st.adf_p(9.0) == 1 and 0.99 < st.adf_p(2.7) < 1


def level_test(x):
    n, r = len(x), x - x.mean()
    s0, s1 = (r @ r) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        p = (r[k:] @ r[: n - k]) / (n / 2)
        s0, s1 = s0 + p, s1 + k * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    variance = (r @ r + 2 * sum((r[k:] @ r[: n - k]) * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    t = (np.cumsum(r) ** 2).sum() / n**2 / variance
    return t, np.interp(t, st.KPSS_CRITICAL, st.KPSS_P), lags


def test_kpss_equals_whole_series(spark):
    got = {r.s: r for r in st.kpss(frame(spark), "s", ["at", "no"], "value").collect()}
    assert set(got) == set(SERIES)
    for s, x in SERIES.items():
        if s in ("flat", "one"):
            assert got[s].statistic is None and got[s].stationary is None
            continue
        t, p, lags = level_test(x)
        assert got[s].lags == lags and abs(got[s].statistic - t) < 1e-4 and abs(got[s].p_value - p) < 1e-5 and got[s].stationary == (p >= 0.05), s


def test_conclusions(spark):
    got = {r.s: r.conclusion for r in st.stationarity(frame(spark), "s", ["at", "no"], "value").collect()}
    for s, x in SERIES.items():
        if s not in ("short", "one", "flat"):
            a, b = st.adf_p(dickey_fuller(x)[0]) < 0.05, level_test(x)[1] >= 0.05
            assert got[s] == ("stationary" if a and b else "trend_stationary" if a else "difference_stationary" if b else "non_stationary")
    assert got["ar"] == "stationary" and got["walk"] == "non_stationary" == got["flat"] and set(got) == set(SERIES)
    assert st.stationarity(frame(spark).limit(0), "s", ["at", "no"], "value").count() == 0


def test_partial_autocorrelation_equals_yule_walker(spark):
    got = {(r.s, r.lag): r for r in st.partial_autocorrelation(frame(spark), "s", ["at", "no"], "value").collect()}
    seen = 0
    for s, x in SERIES.items():
        n, r = len(x), x - x.mean()
        most = min(n // 4, 40)
        assert [k for t, k in sorted(got, key=str) if t == s].__len__() == most + 1
        if s in ("flat", "one"):
            assert got[s, 0].acf is None and got[s, 0].pacf is None
            continue
        c = np.array([r[k:] @ r[: n - k] for k in range(most + 1)])
        g = c / (n - np.arange(most + 1))
        for k in range(most + 1):
            pacf = 1.0 if k == 0 else np.linalg.solve(g[np.abs(np.subtract.outer(range(k), range(k)))], g[1 : k + 1])[-1]
            assert abs(got[s, k].acf - c[k] / c[0]) < 2e-6 and abs(got[s, k].pacf - pacf) < 2e-6 and got[s, k].significant == (k > 0 and abs(c[k] / c[0]) > 0.2)
            seen += 1
    assert seen > 150


def whole_spline(u, v, at):
    """All equations of the cubic pieces at once, in a dense matrix."""
    n, rows, right = len(u) - 1, [], []

    def row(*terms):
        out = np.zeros(4 * n)
        for piece, x, order in terms:
            sign, piece = (1, piece) if piece >= 0 else (-1, -piece - 1)
            d = x - u[piece]
            out[4 * piece : 4 * piece + 4] += sign * np.array([[1, d, d**2, d**3], [0, 1, 2 * d, 3 * d**2], [0, 0, 2, 6 * d], [0, 0, 0, 6]][order])
        return out

    for k in range(n):
        rows += [row((k, u[k], 0)), row((k, u[k + 1], 0))]
        right += [v[k], v[k + 1]]
    for k in range(n - 1):
        rows += [row((k, u[k + 1], o), (-(k + 1) - 1, u[k + 1], o)) for o in (1, 2)]
        right += [0, 0]
    rows += [row((0, u[1], 3), (-1 - 1, u[1], 3)), row((n - 2, u[-2], 3), (-(n - 1) - 1, u[-2], 3))]
    c = np.linalg.solve(np.array(rows), np.array(right + [0, 0])).reshape(n, 4)
    j = np.clip(np.searchsorted(u, at, "right") - 1, 0, n - 1)
    d = at - u[j]
    return (c[j] * np.stack([d**0, d, d**2, d**3], 1)).sum(1)


@pytest.mark.parametrize("size", [40, 1024])
def test_spline_equals_one_system(spark, monkeypatch, size):
    monkeypatch.setattr(st, "SPLINE_BLOCK", size)
    monkeypatch.setattr(st, "SPLINE_REACH", min(size, 64) - 4)
    rng = np.random.default_rng(8)
    series = {"long": 300, "four": 9, "three": 8, "full": 20, "none": 5, None: 60}
    known = {s: rng.random(n) < 0.7 for s, n in series.items()}
    known["long"][:3] = known["long"][-2:] = False
    known["four"][:] = np.isin(np.arange(9), [1, 2, 5, 7])
    known["three"][:] = np.isin(np.arange(8), [1, 2, 5])
    known["full"][:], known["none"][:] = True, False
    data = {s: np.cumsum(rng.normal(size=n)) for s, n in series.items()}
    rows = [(s, START + timedelta(hours=5 * t), t, float(v) if known[s][t] else None) for s, vs in data.items() for t, v in enumerate(vs)]
    got = {(r.s, r.no): r for r in st.spline_filled(spark.createDataFrame(rows, "s string, at timestamp, no int, value double"), "s", ["at", "no"], "value").collect()}
    assert len(got) == len(rows)
    for s, v in data.items():
        u = np.flatnonzero(known[s]).astype(float)
        want = np.where(known[s], v, np.nan)
        if len(u) >= 4:
            want = np.where(known[s], v, whole_spline(u, v[known[s]], np.arange(len(v), dtype=float)))
        for t, w in enumerate(want):
            assert got[s, t].filled == (not known[s][t])
            assert got[s, t].spline is None if math.isnan(w) else abs(got[s, t].spline - w) < 2e-6 * max(1, abs(w)), (s, t)
