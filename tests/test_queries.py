"""Every registered query against its SQL twin, or at least to its end."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import differences

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
