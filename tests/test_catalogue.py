"""Every query with an oracle gives DuckDB's rows on the same tables."""

import duckdb
import pytest
from compare import rows

from pulseframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(name, spark, duck, sf_dir):
    df = catalogue.queries()[name](spark, sf_dir)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(catalogue.oracle_sql()[name])
    want = rows(res.fetchall(), [c[0] for c in res.description])
    assert sorted(df.columns) == sorted(c[0] for c in res.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).limit(5).count() > 0
