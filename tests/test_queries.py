"""Every registered query of the library against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from lodestone.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None).isoformat()
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert ours
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=str)
    assert len(ours) == len(theirs) and ours == theirs
