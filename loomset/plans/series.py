"""Queries of series that are read in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomset.operators import forest
from loomset.operators import stationarity as st
from loomset.plans.catalog import gapped, query, table

_ORDER = ["ts", "event_id"]
_VALUES = """r AS (SELECT event_type AS s, row_number() OVER w - 1 AS i, value - avg(value) OVER (PARTITION BY event_type) AS v, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
p AS (SELECT a.s, a.n, b.i - a.i AS lag, sum(a.v * b.v) AS total FROM r a JOIN r b ON a.s = b.s AND b.i - a.i BETWEEN 0 AND 40 GROUP BY ALL)"""


@query(f"""WITH {_VALUES},
e AS (SELECT s, n, sum(CASE WHEN lag = 0 THEN total / n ELSE total / (n / 2) END) AS s0, sum(CASE WHEN lag > 0 THEN lag * total / (n / 2) ELSE 0 END) AS s1 FROM p WHERE lag <= floor(pow(n, 2 / 9)) GROUP BY s, n),
l AS (SELECT s, n, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3) * pow(n, 1 / 3)), n - 1)::INTEGER AS lags FROM e),
v AS (SELECT p.s, l.n, l.lags, sum(total * CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (lags + 1)) END) / max(l.n) AS variance FROM p JOIN l ON p.s = l.s AND p.lag <= l.lags GROUP BY p.s, l.n, l.lags),
c AS (SELECT s, sum(v) OVER (PARTITION BY s ORDER BY i) AS up FROM r),
t AS (SELECT v.s, v.lags, sum(up * up) / (max(v.n) * max(v.n)) / max(v.variance) AS t FROM c JOIN v ON c.s = v.s GROUP BY v.s, v.lags),
q AS (SELECT *, CASE WHEN t <= 0.347 THEN 0.1 WHEN t <= 0.463 THEN 0.1 - 0.05 * (t - 0.347) / 0.116 WHEN t <= 0.574 THEN 0.05 - 0.025 * (t - 0.463) / 0.111 WHEN t <= 0.739 THEN 0.025 - 0.015 * (t - 0.574) / 0.165 ELSE 0.01 END AS p FROM t)
SELECT s AS event_type, round(t, 4) AS statistic, round(p, 6) AS p_value, lags, p >= 0.05 AS stationary FROM q""")
def kpss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.kpss(table(spark, sf_dir, "events"), "event_type", _ORDER, "value")


@query()
def adf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.adf(table(spark, sf_dir, "events"), "event_type", _ORDER, "value")


@query()
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stationarity(table(spark, sf_dir, "events"), "event_type", _ORDER, "value")


@query(f"""WITH RECURSIVE {_VALUES}, g AS (SELECT s, any_value(n) AS n, list(total ORDER BY lag) AS c, list(total / (n - lag) ORDER BY lag) AS r FROM p GROUP BY s),
z AS (SELECT s, r, 1 AS k, [r[2] / r[1]] AS phi, r[1] * (1 - pow(r[2] / r[1], 2)) AS rest FROM g
  UNION ALL SELECT s, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - x * phi[k + 1 - j]), x), rest * (1 - x * x)
  FROM (SELECT *, (r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1]))) / rest AS x FROM z WHERE k + 1 < len(r)))
SELECT g.s AS event_type, lag::BIGINT AS lag, round(c[lag + 1] / c[1], 6) AS acf, CASE WHEN lag = 0 THEN 1.0 ELSE round(phi[lag], 6) END AS pacf, lag > 0 AND abs(c[lag + 1] / c[1]) > 0.2 AS significant
FROM g, unnest(range(0, least(n // 4, 40) + 1)) AS u(lag) LEFT JOIN z ON z.s = g.s AND z.k = lag""")
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.partial_autocorrelation(table(spark, sf_dir, "events"), "event_type", _ORDER, "value")


@query()
def spline_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.spline_filled(gapped(spark, sf_dir), "event_type", _ORDER, "value")


@query()
def forest_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.forest_anomalies(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 8 + l_linenumber AS line", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "line", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
