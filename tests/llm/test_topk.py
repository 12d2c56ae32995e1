import math

import numpy as np
from pyspark.sql import functions as F

from stretto.llm import topk


def brute(rows, k):
    good = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * float(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(good):
        if qi % 100 == 0:
            s = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, w)))), i) for b, (i, w) in enumerate(good) if a != b)[:k]
            out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * (1 + i % 5)).astype(np.float32).tolist()) for i in range(0, 900, 2)]
    rows += [(1, rows[0][1]), (3, rows[0][1]), (5, [1.0] * 3), (7, None), (9, [float("nan")] * 8), (11, [None] * 8), (None, [1.0] * 8), (13, []), rows[0], rows[0], rows[7], (101, [0.0] * 8), (-100, [float("inf")] * 8), (-200, [0.5] * 8)]
    rows += [(-300, [2.0, 0.0]), (-300, [2.0]), (-300, [0.0]), (200, [0.25] * 8), (0, [0.25] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    for part, pack in ((4096, 4), (60, 1024), (20, 3)):
        monkeypatch.setattr(topk, "PART_ROWS", part)
        monkeypatch.setattr(topk, "PACK_PARTS", pack)
        monkeypatch.setattr(topk, "QUERY_ROWS", 4)
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect()))
        assert got == brute(rows, 10)
    assert len(topk.top_k(df.limit(3), F.col("vec_id") % 100 == 0).collect()) == 2
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3e5, -7.0]), (1, [3e5, 1e9]), (2, [3.5e5, 0.0]), (3, [-1e12, 5e13]), (4, [1e-3, 1.0]), (100, [1e13, 1e13]), (5, [1e15] * 2), (6, [2e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for n in (3, 5, 8):
        assert sorted(map(tuple, topk.top_k(df.where(F.col("vec_id").isin([r[0] for r in rows[:n]])), F.col("vec_id") % 100 == 0).collect())) == brute(rows[:n], 10)


def test_pruning_skips_blocks():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((2000, 6)) * 100 * np.linspace(0.1, 3, 2000)[:, None]).astype(np.int32)
    seen = [s for *_, s in topk.best(np.arange(5), x[:5], np.arange(2000), np.ones(2000, int), x, 10)]
    assert max(seen) < 2000 // topk.BLOCK_ROWS


def test_parts_below_the_bound_are_not_visited():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (400, 6))
    seen = [s for *_, s in topk.best(np.arange(5) + 9000, x[:5] * 40, np.arange(400), np.ones(400, int), x, 10, [10**6] * 5)]
    assert max(seen) == 0
