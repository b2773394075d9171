"""Series taken apart in blocks: unit root and stationarity tests, partial autocorrelation, and splines over gaps.

Rows get their place in the series from their place within the day and the sizes of the days before, so no series is
sorted in one task. Blocks of BLOCK places, with as many rows of the block before as the lags reach back, go to tasks
of their own, which add up products of lagged values. Only those sums, whose number depends on the lags and not on the
series' length, meet in a task for each series, which solves the small equations.

Values that are null or not finite are left out (in splines: are the gaps). A null series is a series like others.
Series that are too short or constant have null results. Rows of the same order values follow each other in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096
#: Known values of a spline's block, and of its neighbours on either side; what lies farther changes nothing within a double's precision.
SPLINE_BLOCK, SPLINE_REACH = 1024, 64

# Published response surfaces of the Dickey-Fuller distribution with a constant (p-values: polynomials
# of the statistic below and above the turn; critical values: polynomials of 1 / observations), and the published
# critical values of the KPSS statistic about a level with their p-values.
ADF_TURN, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
ADF_SMALL, ADF_LARGE = [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]
ADF_CRITICAL = {"critical_1": [-3.43035, -6.5393, -16.786, -79.433], "critical_5": [-2.86154, -2.8903, -4.234, -40.040], "critical_10": [-2.56677, -1.5384, -2.809, 0.0]}
KPSS_CRITICAL, KPSS_P = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]


def placed(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """s, the order columns, v (a double; null unless finite), i (place in the series, from 0) and k (values up to the row)."""
    v = F.col(value).cast("double")
    x = df.select(F.col(series).alias("s"), *order, F.when((v > float("-inf")) & (v < float("inf")), v).alias("v"), F.to_date(order[0]).alias("day"))
    here = Window.partitionBy("s", "day").orderBy(*order)
    x = x.withColumns({"i": F.row_number().over(here) - 1, "k": F.count("v").over(here.rowsBetween(Window.unboundedPreceding, 0))})
    past = Window.partitionBy("s").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    days = x.groupBy("s", "day").agg(F.count("*").alias("n"), F.count("v").alias("m"))
    days = days.select(F.col("s").alias("r_s"), F.col("day").alias("r_day"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n"), F.coalesce(F.sum("m").over(past), F.lit(0)).alias("m"))
    x = x.join(days, x["s"].eqNullSafe(days["r_s"]) & x["day"].eqNullSafe(days["r_day"]))
    return x.select("s", *order, "v", (F.col("i") + F.col("n")).alias("i"), (F.col("k") + F.col("m")).alias("k"))


def values(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """s, i, v (less the series' mean) and n (how many) of each finite value."""
    x = placed(df, series, order, value).filter("v is not null").select("s", (F.col("k") - 1).alias("i"), "v")
    mean = x.groupBy(F.col("s").alias("r_s")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return x.join(mean, x["s"].eqNullSafe(mean["r_s"])).select("s", "i", (F.col("v") - F.col("mean")).alias("v"), "n")


def _in_blocks(x: DataFrame, reach: Column) -> DataFrame:
    """The rows with their block b, and again with the next one's where that reaches back to them."""
    b = F.floor(F.col("i") / BLOCK)
    return x.withColumn("b", F.explode(F.when(F.col("i") + reach >= (b + 1) * BLOCK, F.array(b, b + 1)).otherwise(F.array(b))))


def _sums(x: DataFrame, reach: Column, add: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """s, cell, total: what add(values, places before the block, lags) gives for each block of x (s, i, v, lags), summed by series."""
    kind = x.schema["s"].dataType.simpleString()

    def of_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        lags, start = int(pdf["lags"].iloc[0]), int(pdf["b"].iloc[0]) * BLOCK
        if pdf["i"].iloc[-1] < start:  # only what the block would reach back to
            total = np.zeros(1)
        else:
            total = add(pdf["v"].to_numpy(), start - int(pdf["i"].iloc[0]), lags)
        return pd.DataFrame({"s": [pdf["s"].iloc[0]] * len(total), "cell": np.arange(len(total)), "total": total})

    cells = _in_blocks(x.select("s", "i", "v", "lags"), reach).groupBy("s", "b").applyInPandas(of_block, f"s {kind}, cell int, total double")
    return cells.groupBy("s", "cell").agg(F.sum("total").alias("total"))


def lag_sums(x: DataFrame) -> DataFrame:
    """s, cell (the lag, from 0), total: sums of products of values so far apart, of x (s, i, v, lags)."""

    def add(v: np.ndarray, before: int, lags: int) -> np.ndarray:
        return np.array([v[max(before, k) :] @ v[max(before, k) - k : len(v) - k] if len(v) > max(before, k) else 0.0 for k in range(lags + 1)])

    return _sums(x, F.col("lags"), add)


def _step_moments(x: DataFrame) -> DataFrame:
    """s, cell, total: the upper half of the moments of 1, the value before, the steps 1 to `lags` before, and the step."""

    def add(v: np.ndarray, before: int, lags: int) -> np.ndarray:
        step = np.diff(v)
        t = np.arange(max(before, lags + 1), len(v))
        w = np.column_stack([np.ones(len(t)), v[t - 1], *(step[t - 1 - k] for k in range(1, lags + 1)), step[t - 1]])
        return (w.T @ w)[np.triu_indices(lags + 3)]

    return _sums(x, F.col("lags") + 1, add)


def _square(cells: pd.DataFrame) -> np.ndarray:
    size = round((math.sqrt(8 * len(cells) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = cells.sort_values("cell")["total"].to_numpy()
    return out + np.triu(out, 1).T


def _regression(m: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the last variable on the first k: the sum of squares left, the coefficients and the inverse moments."""
    inverse = np.linalg.inv(m[:k, :k])
    beta = inverse @ m[:k, -1]
    return max(float(m[-1, -1] - beta @ m[:k, -1]), 0.0), beta, inverse


def adf_p(statistic: float) -> float:
    """The approximate p-value of a Dickey-Fuller statistic with a constant."""
    if not ADF_LEAST <= statistic <= ADF_MOST:
        return float(statistic > 0)
    z = sum(c * statistic**e for e, c in enumerate(ADF_SMALL if statistic <= ADF_TURN else ADF_LARGE))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def adf(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """The augmented Dickey-Fuller test with a constant: series, statistic, p_value, lags (by AIC), observations, critical values and stationary (p under 0.05)."""
    x = values(df, series, order, value)
    n, kind = F.col("n"), x.schema["s"].dataType.simpleString()
    most = F.least(F.floor(n / 2) - 2, F.ceil(12 * F.pow(n / 100, 0.25)), F.lit(BLOCK - 2)).cast("int")
    spread = x.groupBy(F.col("s").alias("r_s")).agg(F.max("v").alias("high"), F.min("v").alias("low"), F.max("n").alias("count"))
    fit = x.withColumn("lags", most).filter("lags >= 0")
    fit = fit.join(spread.filter("high > low"), fit["s"].eqNullSafe(F.col("r_s"))).withColumn("v", F.col("v") / (F.col("high") - F.col("low")))  # the test doesn't depend on the unit

    def best(cells: pd.DataFrame) -> pd.DataFrame:
        m, found = _square(cells), []
        n = m[0, 0]
        for lags in range(len(m) - 2):
            try:
                left = _regression(m, lags + 2)[0]
            except np.linalg.LinAlgError:
                continue
            found.append((n * (math.log(2 * math.pi * left / n) + 1) + 2 * (lags + 2) if left > 0 else -math.inf, lags))
        return pd.DataFrame({"s": [cells["s"].iloc[0]], "lags": [min(found)[1] if found else 0]})

    def test(cells: pd.DataFrame) -> pd.DataFrame:
        m = _square(cells)
        n, k = m[0, 0], len(m) - 1
        try:
            left, beta, inverse = _regression(m, k)
            scale = left / (n - k) * inverse[1, 1] if n > k else 0.0
        except np.linalg.LinAlgError:
            scale = 0.0
        return pd.DataFrame({"s": [cells["s"].iloc[0]], "statistic": [beta[1] / math.sqrt(scale) if scale > 0 else math.nan], "lags": [k - 2], "observations": [round(n)]})

    lags = _step_moments(fit).groupBy("s").applyInPandas(best, f"s {kind}, lags int").select(F.col("s").alias("q_s"), F.col("lags").alias("chosen"))
    again = fit.join(lags, fit["s"].eqNullSafe(lags["q_s"])).select("s", "i", "v", F.col("chosen").alias("lags"))
    out = _step_moments(again).groupBy("s").applyInPandas(test, f"s {kind}, statistic double, lags int, observations long").filter("not isnan(statistic)")
    p = F.udf(adf_p, "double")  # a row for each series
    critical = [F.round(sum((F.lit(c) / F.pow("observations", F.lit(float(e))) for e, c in enumerate(cs)), F.lit(0.0)), 4).alias(name) for name, cs in ADF_CRITICAL.items()]
    out = out.withColumn("p", p("statistic"))
    out = spread.select("r_s").join(out, F.col("r_s").eqNullSafe(out["s"]), "left")
    return out.select(F.col("r_s").alias(series), F.round("statistic", 4).alias("statistic"), F.round("p", 6).alias("p_value"), "lags", "observations", *critical, (F.col("p") < 0.05).alias("stationary"))


def kpss(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """The KPSS test about a level: series, statistic, p_value (0.01 to 0.1), lags (from the data) and stationary (p of 0.05 or more)."""
    x = values(df, series, order, value)
    kind = x.schema["s"].dataType.simpleString()
    counts = x.groupBy(F.col("s").alias("r_s")).agg(F.max("n").alias("n"))

    first = lag_sums(x.withColumn("lags", F.floor(F.pow("n", F.lit(2 / 9)) + 1e-12).cast("int")))
    first = first.join(counts, first["s"].eqNullSafe(counts["r_s"]))
    each = first.groupBy("r_s", "n").agg(F.sum(F.when(F.col("cell") == 0, F.col("total") / F.col("n")).otherwise(F.col("total") / (F.col("n") / 2))).alias("s0"), F.sum(F.when(F.col("cell") > 0, F.col("cell") * F.col("total") / (F.col("n") / 2)).otherwise(0.0)).alias("s1"))
    ratio = F.try_divide("s1", "s0")
    own = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3)))
    lags = each.filter("s0 is not null and s0 <> 0").select(F.col("r_s").alias("q_s"), F.least(own, F.col("n") - 1, F.lit(BLOCK - 1)).cast("int").alias("lags"), F.col("n").alias("count"))

    sums = lag_sums(x.join(lags, x["s"].eqNullSafe(lags["q_s"])).select("s", "i", "v", "lags"))
    sums = sums.join(lags, sums["s"].eqNullSafe(lags["q_s"]))
    weight = F.when(F.col("cell") == 0, 1.0).otherwise(2 * (1 - F.col("cell") / (F.col("lags") + 1)))
    variance = sums.groupBy("q_s", "count", "lags").agg(F.sum(F.col("total") * weight).alias("variance"))

    def running(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.cumsum(pdf.sort_values("i")["v"].to_numpy())
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "b": [int(pdf["b"].iloc[0])], "n": [len(c)], "total": [c[-1]], "one": [c.sum()], "two": [c @ c]})

    parts = x.select("s", "i", "v", F.floor(F.col("i") / BLOCK).alias("b")).groupBy("s", "b").applyInPandas(running, f"s {kind}, b long, n long, total double, one double, two double")
    past = F.coalesce(F.sum("total").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each block
    eta = parts.withColumn("past", past).groupBy("s").agg(F.sum(F.col("n") * F.col("past") * F.col("past") + 2 * F.col("past") * F.col("one") + F.col("two")).alias("eta"))
    met = variance.join(eta, variance["q_s"].eqNullSafe(eta["s"])).select(F.col("q_s").alias("z_s"), "lags", F.try_divide(F.col("eta") / (F.col("count") * F.col("count")), F.col("variance") / F.col("count")).alias("statistic"))

    p, t = F.lit(KPSS_P[-1]), F.col("statistic")
    for a, b, high, low in reversed(list(zip(KPSS_CRITICAL, KPSS_CRITICAL[1:], KPSS_P, KPSS_P[1:], strict=False))):
        p = F.when(t <= b, high + (low - high) * (t - a) / (b - a)).otherwise(p)
    p = F.when(t <= KPSS_CRITICAL[0], KPSS_P[0]).when(t.isNotNull(), p)
    out = counts.select("r_s").join(met, F.col("r_s").eqNullSafe(met["z_s"]), "left").withColumn("p", p)
    return out.select(F.col("r_s").alias(series), F.round("statistic", 4).alias("statistic"), F.round("p", 6).alias("p_value"), F.col("lags").cast("int").alias("lags"), (F.col("p") >= 0.05).alias("stationary"))


def stationarity(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Both tests' statistics and p-values, and what they say together; a test without a result counts as not stationary."""
    a = adf(df, series, order, value).select(F.col(series).alias("a_s"), F.col("statistic").alias("adf_statistic"), F.col("p_value").alias("adf_p"), F.coalesce("stationary", F.lit(False)).alias("a"))
    b = kpss(df, series, order, value).select(F.col(series).alias("b_s"), F.col("statistic").alias("kpss_statistic"), F.col("p_value").alias("kpss_p"), F.coalesce("stationary", F.lit(False)).alias("b"))
    says = F.when(F.col("a") & F.col("b"), "stationary").when(F.col("a"), "trend_stationary").when(F.col("b"), "difference_stationary").otherwise("non_stationary")
    return a.join(b, a["a_s"].eqNullSafe(b["b_s"])).select(F.col("a_s").alias(series), "adf_statistic", "adf_p", "kpss_statistic", "kpss_p", says.alias("conclusion"))


def partial_autocorrelation(df: DataFrame, series: str, order: list[str], value: str, most: int = 40) -> DataFrame:
    """series, lag (from 0 to a quarter of the series, `most` at most), acf, pacf and significant (acf over 0.2 in size; not lag 0).

    Partial autocorrelations solve the Yule-Walker equations, whose sums are divided by the number of their terms,
    step by step. A constant series has nulls.
    """
    x = values(df, series, order, value)
    kind = x.schema["s"].dataType.simpleString()
    sums = lag_sums(x.withColumn("lags", F.least(F.floor(F.col("n") / 4), F.lit(most)).cast("int")))
    counts = x.groupBy(F.col("s").alias("r_s")).agg(F.max("n").alias("n"))
    sums = sums.join(counts, sums["s"].eqNullSafe(counts["r_s"])).select("s", "cell", "total", "n")

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        total = cells.sort_values("cell")["total"].to_numpy()
        n, size = int(cells["n"].iloc[0]), len(total)
        acf = total / total[0] if total[0] > 0 else np.full(size, np.nan)
        return pd.DataFrame({"s": [cells["s"].iloc[0]] * size, "lag": np.arange(size), "acf": acf, "pacf": levinson(total / (n - np.arange(size)))})

    out = sums.groupBy("s").applyInPandas(solve, f"s {kind}, lag long, acf double, pacf double").replace(float("nan"), None, subset=["acf", "pacf"])
    return out.select(F.col("s").alias(series), "lag", F.round("acf", 6).alias("acf"), F.round("pacf", 6).alias("pacf"), ((F.col("lag") > 0) & (F.abs("acf") > 0.2)).alias("significant"))


def levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocovariances, by the recursion over ever longer equations; not a number once nothing is left to explain."""
    out = np.full(len(r), np.nan)
    if r[0] <= 0:
        return out
    out[0], phi, left = 1.0, np.zeros(0), r[0]
    for k in range(1, len(r)):
        if left == 0:
            break
        out[k] = (r[k] - phi @ r[k - 1 : 0 : -1]) / left
        phi = np.append(phi - out[k] * phi[::-1], out[k])
        left *= 1 - out[k] ** 2
    return out


def spline_filled(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """The series, order columns, spline and filled: gaps on the cubic spline through the known values by place, whose ends are one cubic over two steps each.

    Beyond the known values their end's cubic goes on. Gaps of a series of fewer than four values stay null.
    """
    x = placed(df, series, order, value)
    known = x.groupBy(F.col("s").alias("r_s")).agg(F.count("v").alias("all"))
    x = x.join(known, x["s"].eqNullSafe(known["r_s"])).drop("r_s")
    last = F.floor((F.greatest("all", F.lit(1)) - 1) / SPLINE_BLOCK)
    own = F.floor(F.greatest(F.col("k") - 1, F.lit(0)) / SPLINE_BLOCK)
    low, high = (F.least(F.greatest(F.floor((F.col("k") - 1 + side * SPLINE_REACH) / SPLINE_BLOCK), F.lit(0)), last) for side in (-1, 1))
    x = x.withColumn("own", own).withColumn("b", F.explode(F.when(F.col("v").isNotNull(), F.sequence(low, high)).otherwise(F.array("own"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select("s", *order).schema) + ", spline double, filled boolean"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        is_known = pdf["v"].notna().to_numpy()
        out = pdf["v"].to_numpy(dtype=float, copy=True)
        if is_known.sum() >= 4 and not is_known.all():
            out[~is_known] = spline(pdf["i"].to_numpy(float)[is_known], out[is_known], pdf["i"].to_numpy(float)[~is_known])
        pdf = pdf.assign(spline=pd.Series(out, index=pdf.index).round(6).astype(object).where(~np.isnan(out), None), filled=~is_known)
        return pdf.loc[pdf["own"] == pdf["b"], ["s", *order, "spline", "filled"]]

    return x.groupBy("s", "b").applyInPandas(fill, schema).withColumnRenamed("s", series)


def spline(u: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through four points or more, rising in u, without a knot at the second and the last but one; beyond the ends their cubics go on."""
    h, slope = np.diff(u), np.diff(v) / np.diff(u)
    # second derivatives at the inner points; those at the ends follow on a line from the two beside them
    low, mid, high, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    mid[0] += h[0] * (h[0] + h[1]) / h[1]
    high[0] -= h[0] * h[0] / h[1]
    mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    low[-1] -= h[-1] * h[-1] / h[-2]
    for k in range(1, len(mid)):
        part = low[k] / mid[k - 1]
        mid[k] -= part * high[k - 1]
        right[k] -= part * right[k - 1]
    m = np.zeros(len(u))
    m[-2] = right[-1] / mid[-1]
    for k in range(len(mid) - 2, -1, -1):
        m[k + 1] = (right[k] - high[k] * m[k + 2]) / mid[k]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    j = np.clip(np.searchsorted(u, at, "right") - 1, 0, len(h) - 1)
    d = at - u[j]
    return v[j] + d * (slope[j] - h[j] * (2 * m[j] + m[j + 1]) / 6 + d * (m[j] / 2 + d * (m[j + 1] - m[j]) / (6 * h[j])))
