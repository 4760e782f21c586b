"""Queries of the corpus operators that SQL can express, against DuckDB."""

import duckdb
import pytest
from compare import rows

from pulseframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    res = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, sf_dir)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(res.fetchall(), [c[0] for c in res.description])
