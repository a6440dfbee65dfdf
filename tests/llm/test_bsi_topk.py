import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import bsi_topk as B


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        for rank, (s, i) in enumerate(scored, 1):
            yield q, rank, i, -s


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    return sorted(tuple(r) for r in B.top_k(df, F.col("id") % 20 == 0, k).collect())


def test_edges_and_ties_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(np.float32(x)) for x in v] for v in rng.normal(size=(300, 5)) * 0.2]
    rows = list(enumerate(vectors))
    rows += [(1000 + i, vectors[3]) for i in range(40)]  # a tie far larger than k
    rows += [(900, None), (901, []), (902, [None] * 5), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (None, vectors[0]), (905, [0.5])]
    rows += [(7, vectors[7]), (2000, [0.0] * 5), (2001, [-1.0] * 5), (2020, [1.0] * 5)]
    assert run(spark, rows) == sorted(brute(rows, 20))


def test_fewer_rows_than_k_and_empty_table(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.3, -0.2])]
    assert run(spark, rows) == sorted(brute(rows, 20))
    assert run(spark, [(0, [0.1])]) == [] and run(spark, []) == []


def test_several_blocks_and_slabs(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "SLAB_QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(400)]
    assert run(spark, rows, 7) == sorted(brute(rows, 7))


def test_score_slices_add_up():
    rng = np.random.default_rng(6)
    values, query = rng.integers(-40, 40, (130, 6)), rng.integers(-64, 64, 6)
    index = B.Index(np.arange(130), values)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, s in enumerate(index.score_slices(query)))
    exact = values @ query
    assert len(set((total - exact).tolist())) == 1
