"""Queries of this subpackage that have SQL, against it."""

import duckdb
import pytest

from annalist.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, sf_dir), con.sql(ORACLE[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*columns).collect()), key=repr) == sorted(theirs.select(*map(duckdb.ColumnExpression, columns)).fetchall(), key=repr)
    assert [{"BIGINT": "bigint", "VARCHAR": "string"}[str(t)] for t in theirs.types] == [dict(ours.dtypes)[c] for c in theirs.columns]
