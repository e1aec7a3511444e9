import math

import numpy as np
from pyspark.sql import functions as F

from motifline.llm import topk


def brute(rows, k=5):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in valid if i % 50 == 0}:
        scored = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), j) for j, v in valid if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as x", "3 as score")
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())


def test_block_search_equals_matrix_product():
    rnd = np.random.default_rng(1)
    for n, spread in ((1, 3), (4, 40), (700, 33), (900, 2), (500, 0)):
        x = (rnd.normal(size=(n, 16)) * spread).astype(np.int64)
        ids = rnd.permutation(10 * n)[:n]
        q = x[: min(n, 20)]
        found = topk.search_block(ids, x, ids[: len(q)], q, 5)
        expected = []
        for i, v in zip(ids, q):
            scored = sorted((-int(s), int(j)) for s, j in zip(x @ v, ids) if j != i)[:5]
            expected += [(int(i), j, -s) for s, j in scored]
        assert sorted(zip(*[a.tolist() for a in found])) == sorted(expected)


def test_proof_stops_before_all_segments(monkeypatch):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(100, 32)) * 60
    x = np.rint(centres[np.arange(3000) % 100] + rnd.normal(size=(3000, 32)) * 3).astype(np.int64)
    calls = []
    monkeypatch.setattr(topk.np, "partition", lambda a, *b, f=np.partition, **c: calls.append(len(a)) or f(a, *b, **c))
    found = topk.search_block(np.arange(3000), x, np.arange(50), x[:50], 5)
    assert max(calls) == 50 and calls[-1] < 10 and len(found[0]) == 250  # hardly a query needs the last segment


def test_rows_with_nulls_ties_copies_and_other_lengths(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 8), (401, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(450, [0.5, 0.5]), (500, [1.0] * 10), (7, rows[7][1]), (50, rows[50][1]), (900, rows[7][1])]
    assert got(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert got(spark, [(50, [1.0]), (1, [0.5]), (2, [-0.25])]) == [(50, 1, 1, 256 * 128), (50, 2, 2, -64 * 256)]
    assert got(spark, [(50, [1.0])]) == []
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_blocks_and_batches(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = [(i * 10, rnd.normal(size=4).tolist()) for i in range(400)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 90)
    monkeypatch.setattr(topk, "BATCH_ROWS", 30)
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    """Beyond 32 bits a component, beyond 2**53 a sum, beyond 64 bits a score."""
    rnd = np.random.default_rng(7)
    for size in (2e6, 1e7, 1e12):
        rows = [(i, [float(v) for v in rnd.normal(size=6) * size]) for i in range(200)]
        rows += [(200 + i, [rows[0][1][0] + i / 256, *rows[0][1][1:]]) for i in range(40)]  # near ties
        assert got(spark, rows) == brute(rows)
    found = got(spark, [(0, [1e300, -1e300]), (1, [1e300, 1.0]), (2, [-1e300, 1e300]), (3, [0.0, 0.0])])
    assert found == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 0), (0, 3, 2, -(2**63))]
