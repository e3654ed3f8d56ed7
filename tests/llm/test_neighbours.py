"""Neighbours that codes can't tell apart."""

from __future__ import annotations

import numpy as np

from gridloom.llm import additive_ann


def test_tight_clusters_lose_no_neighbour(spark):
    """Members of a cluster differ by far less than a code does from its vector."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(60, 16))[np.arange(3000) % 60 // 20 * 20] + rng.normal(size=(3000, 16)) * 1e-4).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in additive_ann.nearest(df, books=2, candidates=60, sample=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 3000, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        assert [i for _, i in sorted(got[q])] == np.argsort(-cos)[:5].tolist()
