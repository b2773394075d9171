"""A Spark query's rows held against DuckDB's over the same Parquet files."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    """Values of both engines in one form."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return sorted((str(k), plain(v)) for k, v in x.items())
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def assert_same(df, sf_dir, sql):
    names, want = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, want)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b
