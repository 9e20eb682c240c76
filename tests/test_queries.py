"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.QUERIES if n in entry.ORACLE_SQL)


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = entry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(entry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    rows = lambda x: sorted(tuple(map(shown, r)) for r in x)
    assert rows(got.select(*columns).collect()) == rows(con.sql(f"SELECT {picked} FROM ({entry.ORACLE_SQL[name]})").fetchall())


def test_extractors_read_documents(spark, tmp_path):
    from reqlens.queries import TEXTS

    long = "слово " * 3000
    rows = [*TEXTS, (20, long + "Хранить 30 суток."), (21, None), (22, long + "Система не должна передавать данные.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in entry.QUERIES["constraints_documents"](spark, str(tmp_path)).collect()}
    assert found == {(1, "retention_period", ">=", 90.0, "days"), (2, "response_time", "<=", 2.0, "sec"), (3, "retention_period", "=", 30.0, "days"), (9, "size", "<=", 200.0, "mb"), (20, "retention_period", "=", 30.0, "days")}
    modality = {r["doc_id"]: r["modality"] for r in entry.QUERIES["modality_documents"](spark, str(tmp_path)).collect()}
    assert modality == {r["id"]: r["modality"] for r in entry.QUERIES["modality"](spark, DATA).collect()} | {20: "unknown", 21: "unknown", 22: "must_not"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
