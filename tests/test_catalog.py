"""Every query of the catalog runs; those with SQL give DuckDB's rows."""

import pytest

from loomset.plans import catalog, derived, exports, items, leakage, media, page_parts, series, streams, vectors  # noqa: F401
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if sql := catalog.ORACLE_SQL.get(name):
        assert_same(df, SF, sql)
    else:
        assert df.columns and df.count() >= 0


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
