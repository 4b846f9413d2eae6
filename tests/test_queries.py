"""Every registered relational query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    return round(float(x), 5) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLE:
        assert df.columns
        return
    want = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, want.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert "scan_rank_threshold" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
