"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from ledgerloom.plans import account_queries, lake_queries, lookup_queries, raw_queries, registry, serving_queries, source_queries, tag_queries, update_queries, utxo_queries
from ledgerloom.sources.account_projection import AccountLedger
from ledgerloom.sources.projection import Ledger


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    ledger = Ledger(spark, sf_dir, keep=True)
    account, tags = AccountLedger(spark, sf_dir, keep=True), tag_queries.Tags(spark, sf_dir, ledger)
    kinds = {Ledger: ledger, AccountLedger: account, None: None}
    of = {name: made for group, made in ((utxo_queries, ledger), (serving_queries, ledger), (account_queries, account), (tag_queries, tags)) for name in group.QUERIES}
    return of | {name: kinds[kind] for group in (lookup_queries, update_queries) for name, kind in group.KINDS.items()}


def plain(value):
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


ALL = (account_queries, lake_queries, lookup_queries, raw_queries, serving_queries, source_queries, tag_queries, update_queries, utxo_queries)
GROUPS = {name: group for group in ALL for name in group.QUERIES}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, db, made, name):
    extra = {"made": made[name]} if made.get(name) else {}
    got = registry.QUERIES[name](spark, sf_dir, **extra)
    want = db.sql(registry.SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted((repr(tuple(plain(v) for v in r)) for r in got.select(*columns).collect()))
    where = [want.columns.index(c) for c in columns]
    assert rows, "a query without rows shows nothing"
    assert rows == sorted(repr(tuple(plain(r[i]) for i in where)) for r in want.fetchall())


def test_names_are_in_one_group_and_have_sql():
    assert len(GROUPS) == len(registry.QUERIES) == sum(len(g.QUERIES) for g in ALL)
    assert set(registry.SQL) <= set(registry.QUERIES)
