"""Every registered query against its SQL on a second engine."""

from __future__ import annotations

import pytest
from compare import differences, engine

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return engine(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    rows = frame.collect()
    assert frame.columns
    if name in SQL:
        assert differences(rows, frame.columns, con, SQL[name]) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {"distribution", "anomaly"} <= {r["stat_type"] for r in rows}
