"""The entry module, and the SQL of a few queries on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_registry():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["split_labels", "covis_topk", "eval_by_type", "pair_windows", "history_features"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in cur.fetchall())
    got = sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*columns).collect())
    assert got == want
