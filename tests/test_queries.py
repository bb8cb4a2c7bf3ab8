"""Every registered query against its SQL oracle on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import canonical, connect, difference, oracle

QUERIES = {name: e.run for name, e in entry.ENTRIES.items()}
ORACLES = {name: e.sql for name, e in entry.ENTRIES.items() if e.sql is not None}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    columns, expected, _ = oracle(con, ORACLES[name])
    assert difference(canonical(df.columns, rows), canonical(columns, expected)) is None


def test_many_descriptions_equal_single_ones(spark, sf):
    """One job's worth of counts, the same rows as a call for each table."""
    from tabulary.operators import discovery
    from tabulary.plans.catalogue import desk

    served = desk(spark, sf)
    names = [(d, t.name) for d in served.registry.databases for t in served.registry.visible_tables(d)]
    many = discovery.describe_tables(spark, served.registry, names, served.open)
    got = {(r["database"], r["name"]): r for r in many.collect()}
    for database, name in names:
        (one,) = served.describe_table(database, name).data.collect()
        assert {c: one[c] for c in one.__fields__} == {c: got[database, name][c] for c in one.__fields__}
