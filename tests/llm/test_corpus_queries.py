"""The corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from reqlens.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x)
    assert rows(got.select(*columns).collect()) == rows(con.sql(f"SELECT {picked} FROM ({ORACLE_SQL[name]})").fetchall())
