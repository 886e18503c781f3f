"""The registered queries of the training-data operators against their SQL."""

import os

import pytest

from concordat.llm import oracle, queries

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    return repr(float(f"{float(v):.9g}")) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.queries()[name](spark, SF)
    cursor = con.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    key = sorted(names)
    assert sorted(frame.columns) == key
    want = sorted(tuple(plain(r[names.index(c)]) for c in key) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in key) for r in frame.collect()) == want
