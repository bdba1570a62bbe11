"""Every query with an oracle matches DuckDB on the sf0.001 tables; every
query without one still runs over the whole tables."""

import sys
import os

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, digest, spark_type  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: spark_type(f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {c[0]: str(c[1]).upper().replace(" ", "") for c in cur.description}
    assert stypes == dtypes
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]


def test_every_query_has_an_oracle():
    from tallyfold.plans import registry
    registry.load_all()
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 1
