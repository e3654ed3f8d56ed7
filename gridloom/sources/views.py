"""Raster, terrain, series, catalogue and ledger tables derived from the standard test tables.

Each view is one text of SQL that Spark and other engines read alike. Names in braces
are the tables and views it is made from.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "grid_side": "SELECT greatest(16, CAST(floor(sqrt(count(*) / CAST(56 AS DOUBLE))) AS BIGINT)) AS side FROM {lineitem}",
    "px": """SELECT l_linestatus AS site, CAST(year(l_shipdate) AS BIGINT) AS scene, l_orderkey % side AS r, l_partkey % side AS c,
        SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / (CAST(100 AS DOUBLE) * COUNT(*)) AS red,
        SUM(CAST(l_quantity AS BIGINT)) * CAST(1000 AS DOUBLE) / COUNT(*) AS blue,
        SUM(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) / (CAST(100 AS DOUBLE) * COUNT(*)) AS nir,
        SUM(CAST(round(l_discount * 100) AS BIGINT)) / (CAST(10 AS DOUBLE) * COUNT(*)) AS prob,
        CASE WHEN SUM(CAST(round(l_tax * 100) AS BIGINT)) >= 5 * COUNT(*) THEN 1 ELSE 0 END AS target
      FROM {lineitem} CROSS JOIN {grid_side} GROUP BY 1, 2, 3, 4""",
    "dem": """SELECT CAST(floor(p_partkey / w) AS BIGINT) AS r, p_partkey % w AS c, p_retailprice + p_size AS elev
      FROM {part} CROSS JOIN (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM {part}) s WHERE p_partkey < n - n % w""",
    "series": """SELECT user_id AS k, CAST(2024 AS DOUBLE) + (CAST(dayofyear(ts) AS BIGINT) - 1) / CAST(366 AS DOUBLE) AS t,
        SUM(CAST(round(value * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS area FROM {events} GROUP BY user_id, dayofyear(ts)""",
    "scored": """SELECT l.doc_id, l.doc_id % 5 AS fold, (d.n_chars % 1000) / CAST(999 AS DOUBLE) AS prob, l.toxic AS target
      FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "product_id": """SELECT o_orderkey,
        concat('ESP_', lpad(CAST(o_orderkey AS VARCHAR(20)), 6, '0'), '_', lpad(CAST(o_custkey % 1800 AS VARCHAR(20)), 4, '0')) AS obs_id,
        concat('B', lpad(CAST(o_orderkey % 20 AS VARCHAR(20)), 2, '0'), '_', lpad(CAST(o_orderkey AS VARCHAR(20)), 6, '0'), '_XN_',
          CAST(o_custkey % 90 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE 'N' END, CAST(o_orderkey % 360 AS VARCHAR(20)), 'W') AS ctx_id
      FROM {orders}""",
    "footprint": """SELECT c_custkey AS id, (c_custkey * 7919 % 35000) / CAST(100 AS DOUBLE) AS lon0, (c_custkey * 104729 % 17000) / CAST(100 AS DOUBLE) - 90 AS lat0,
        (c_custkey * 7919 % 35000) / CAST(100 AS DOUBLE) + 2 AS lon1, (c_custkey * 104729 % 17000) / CAST(100 AS DOUBLE) - 88 AS lat1 FROM {customer}""",
    "sites": """SELECT n_nationkey AS site, n_name AS name, n_nationkey * CAST(14 AS DOUBLE) AS lon0, n_nationkey * CAST(6 AS DOUBLE) - 80 AS lat0,
        n_nationkey * CAST(14 AS DOUBLE) + 12 AS lon1, n_nationkey * CAST(6 AS DOUBLE) - 70 AS lat1 FROM {nation}""",
    "ledger": """SELECT o_orderpriority AS step, o_custkey AS key, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status,
        o_orderdate AS ts, o_orderkey AS seq FROM {orders}""",
    "history": """SELECT event_type AS run, CAST(dayofyear(ts) AS BIGINT) AS epoch, SUM(CAST(round(value * 100) AS BIGINT)) / (CAST(50000 AS DOUBLE) * COUNT(*)) AS iou
      FROM {events} GROUP BY event_type, dayofyear(ts)""",
}
_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """The base tables and derived views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in VIEWS:
                text = VIEWS[name]
                self._known[name] = self.spark.sql(text, **{n: getattr(self, n) for n in set(_NAME.findall(text))})
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    @cached_property
    def side(self) -> int:
        """The side of the pixel grid."""
        return self.grid_side.first()["side"]


def _needed(text: str) -> list[str]:
    out: list[str] = []
    for name in dict.fromkeys(_NAME.findall(text)):
        if name in VIEWS:
            for n in [*_needed(VIEWS[name]), name]:
                if n not in out:
                    out.append(n)
    return out


def with_views(text: str, recursive: bool = False) -> str:
    """``text`` as one statement for an engine that has the base tables: the views in braces become CTEs before it.

    A text that begins with ``WITH`` adds its own CTEs.
    """
    needed = _needed(text)
    plain = lambda s: _NAME.sub(r"\1", s)
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in needed]
    body = plain(text).strip()
    if body.upper().startswith("WITH "):
        ctes.append(body[5:])
        body = ""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
