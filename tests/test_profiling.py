"""Quartile fences at the ends of what a column may hold."""

import pytest

from loomset.operators import profiling

INF = float("inf")


@pytest.mark.parametrize("values", [[5.0] * 6, [1.0, 2.0, 3.0, 4.0, None, 1e12], [-INF, 1.0, 2.0, 3.0, 900.0, INF], [-3.0, 0.5, 0.25, 7.0, 7.0, 2000.0, -8.0]])
def test_fences_are_order_statistics(spark, values):
    got = profiling.iqr_fences(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    known = sorted(v for v in values if v is not None)
    n = len(known)
    assert [(r.q1, r.q3) for r in got] == [(known[n // 4], known[3 * n // 4])]


def test_too_few_values_have_no_fences(spark):
    assert profiling.iqr_fences(spark.createDataFrame([(1.0,), (None,)], "v double"), "v").count() == 0
    assert profiling.iqr_fences(spark.createDataFrame([], "v double"), "v").count() == 0
