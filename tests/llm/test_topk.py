import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import topk as T


def brute(rows, every, k):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound[i, tuple(v)] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for (q, qv), a in sound.items():
        if q % every == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), c) for (c, cv), b in sound.items() if c != q and len(cv) == len(qv)))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def run(spark, rows, every=5, k=3):
    got = T.exact_topk(frame(spark, rows), F.col("vec_id") % every == 0, k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_same_as_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(T, "BLOCK_ROWS", 16)
    monkeypatch.setattr(T, "QUERY_ROWS", 8)
    r = np.random.default_rng(4)
    v = r.normal(size=(220, 8)) * np.exp(spread * r.normal(size=(220, 1)))
    v[::7] = v[3]  # equal vectors: ties
    v[11] = 0
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_high_cosines_prune_by_coordinate(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 32)
    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 12))
    v = (centres[r.integers(0, 6, 300)] + 0.05 * r.normal(size=(300, 12))) * r.uniform(0.8, 1.2, (300, 1))
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_edge_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (10, [0.5, 0.5]), (11, []), (15, []), (20, [-1.0, -0.001]), (6, [3.0])]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(np.float32(3e6 + i * 7)), float(np.float32(2.5e6 - i * 3))]) for i in range(12)]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_short_blocks_are_pruned_before_rows_move(spark, monkeypatch):
    """With mixed norms most pairs of blocks can't reach a query's floor; they never get to the search."""
    monkeypatch.setattr(T, "BLOCK_ROWS", 32)
    monkeypatch.setattr(T, "RANGE_ROWS", 32)
    monkeypatch.setattr(T, "QUERY_ROWS", 16)
    r = np.random.default_rng(2)
    v = r.normal(size=(900, 6))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(1.5 * r.normal(size=(900, 1)))
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    seen, real = [], T._wanted

    def wanted(asked, asked_blocks, blocks, firsts, floors):
        out = real(asked, asked_blocks, blocks, firsts, floors)
        seen.append((out.count(), asked_blocks.count() * (blocks.count() - 1)))
        return out

    monkeypatch.setattr(T, "_wanted", wanted)
    assert run(spark, rows, 30) == brute(rows, 30, 3)
    assert seen[0][0] < 0.6 * seen[0][1], seen
