"""Queries of the training-data operators against their SQL, on the smallest tables and on awkward rows."""

import duckdb
import pytest

from isophase.llm import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


def same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_tables(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows(spark, tmp_path, name):
    long = " ".join(f"w{i % 70}é" for i in range(400))
    docs = [(1, long, "a"), (2, None, None), (3, "", "a"), (4, "x " + long, "b"), (5, "only\ta few\nwords", "b"), (6, long, None), (7, "z" * 450, "c")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (2, 0, "user", "no reply"), (3, 0, "assistant", None), (4, 0, "user", None), (4, 1, "assistant", "é")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/c")
    spark.read.parquet(f"{tmp_path}/d").coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/c").coalesce(1).toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    same(spark, str(tmp_path), name)
