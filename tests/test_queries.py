"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from compare import rows

import __spark_entry__
from siftwell.plans import catalogue


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(sql.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "chunk_id", "score", "rank"]
    assert df.count() > 0


def test_names_are_registered():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert set(catalogue.QUERIES) <= set(known)
