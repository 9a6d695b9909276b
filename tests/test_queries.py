"""Every query of the ledger operators gives the rows of its SQL."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from ledgerweave.plans.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    found = rows_of(df.columns, df.collect())
    if name in ORACLE_SQL:
        want = oracle.sql(ORACLE_SQL[name])
        assert found == rows_of(want.columns, want.fetchall())


def test_contract(spark):
    import __spark_entry__ as contract

    queries = contract.queries()
    assert set(QUERIES) <= set(queries)
    assert set(contract.oracle_sql()) <= set(queries)
    assert contract.entry(spark).count() > 0
