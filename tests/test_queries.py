"""Every query with SQL against DuckDB on the smallest tables; every query gives rows of a stable schema."""

import math

import pytest

from spanlake.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    return c


def norm(rows):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in Q.SQL:
        names = ", ".join(f'"{c}"' for c in df.columns)
        want = duck.sql(f"SELECT {names} FROM ({Q.SQL[name]})").fetchall()
        assert norm(got) == norm(want)
    else:
        assert len(df.columns) == len(set(df.columns))


def test_md5_heads():
    from hashlib import md5

    import numpy as np

    prefixes, which, number = [b"g1:", b"tf" + b"9" * 19 + b":", b"l-5:"], [0, 1, 2, 1, 0], [0, 9, 10, 2**31 - 1, 99999]
    want = [int(md5(prefixes[i] + str(k).encode()).hexdigest()[:8], 16) for i, k in zip(which, number, strict=True)]
    assert Q.md5_heads(prefixes, np.array(which), np.array(number, np.int32)).tolist() == want
    assert Q.md5_heads([], np.zeros(0, int), np.zeros(0, np.int32)).tolist() == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
