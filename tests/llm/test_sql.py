import duckdb
import pytest

from lodestone.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(r[names.index(c)] for c in columns) for r in got.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == theirs and theirs
