"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from gridloom import registry
from tests.oracle import database, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, db, name):
    assert differences(registry.queries()[name](spark, SF), db, registry.oracles()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
