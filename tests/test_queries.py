"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from isophase import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: (v is None, str(type(v)), v if v is not None else 0)
    out = [tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and not any(v is None for r in rows for v in r)
