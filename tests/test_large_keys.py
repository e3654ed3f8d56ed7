"""Keys of seven digits, as large tables have them, beside SQL."""

from __future__ import annotations

import duckdb
import pytest

from gridloom import registry
from tests.oracle import differences


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("keys")
    db = duckdb.connect()
    db.execute(f"COPY (SELECT CAST(k AS BIGINT) AS o_orderkey, CAST(k * 7 % 3 AS BIGINT) AS o_custkey FROM (SELECT unnest(range(1234500, 1234700)) AS k UNION ALL SELECT unnest([1, 99, 100, 999999, 98765432]))) TO '{path}/orders.parquet'")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet'")
    return str(path), db


@pytest.mark.parametrize("name", ["keys_except", "orbit_block", "product_urls", "stems_union", "stems_intersect", "sort_key"])
def test_matches_sql(spark, tables, name):
    path, db = tables
    assert differences(registry.queries()[name](spark, path), db, registry.oracles()[name]) == ""
