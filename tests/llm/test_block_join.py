from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from debtscope.llm import block_join as B


def brute(rows, asks, k):
    """Rows that repeat an id count once, by the vector that sorts first."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(v, best.get(i, v))
    out = []
    for q, x in best.items():
        if asks(q):
            near = sorted((math.dist(x, v), i) for i, v in best.items() if i != q and len(v) == len(x))[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 8192])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(B, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(B, "QUERY_BLOCK", max(2, block // 8))
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype("f4")]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, []), (302, [0.0] * 8), (310, [math.nan] * 8), (320, [1.0] * 7 + [None]), (330, [math.inf] * 8),
             (None, [1.0] * 8), (340, [1.0, 2.0]), (341, [1.0, 3.0]), (20, [0.5] * 8), rows[10], (350, [1e-30] * 8), (360, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({n: F.lit("own") for n in ("id", "vec", "c", "q", "dim", "rank")})
    got = sorted(map(tuple, B.neighbours(df, F.col("vec_id") % 10 == 0, 5).collect()))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in B.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 2.0)]
    assert B.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 16)) * rng.choice([1e-6, 1, 1e6], (50, 1))
    q, scale, loss = B.quantise(x)
    assert np.abs(q).max() <= 127 and np.all(np.linalg.norm(x - q * scale[:, None], axis=1) <= loss + 1e-12 * np.linalg.norm(x, axis=1))
