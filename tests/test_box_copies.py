"""Boxes are copied a few times, however dense they lie."""

from __future__ import annotations

import random

import gridloom.operators.catalogue as c


def test_wide_boxes_are_not_cut_up(spark, monkeypatch):
    rng, seen, original = random.Random(4), {}, c._in_cells
    box = lambda k, w: (lambda x, y: (k, x, y, x + w, y + w))(rng.uniform(20, 30), rng.uniform(5, 15))
    rows = [box(k, 2.0 if k % 10 else 0.01) for k in range(2000)]
    sites = [box(k, 3.0) for k in range(5)]
    monkeypatch.setattr(c, "_in_cells", lambda df, splits, levels: seen.setdefault(df.columns[0], original(df, splits, levels)))
    names = "lon0 double, lat0 double, lon1 double, lat1 double"
    out = c.bbox_search(spark.createDataFrame(rows, f"id long, {names}"), spark.createDataFrame(sites, f"site long, {names}"), crowd=10)
    got = [tuple(r) for r in out.collect()]
    want = {(s[0], i[0]) for s in sites for i in rows if i[1] <= s[3] and i[3] >= s[1] and i[2] <= s[4] and i[4] >= s[2]}
    assert len(got) == len(set(got)) and set(got) == want
    assert seen["id"].count() <= 4 * 2000
