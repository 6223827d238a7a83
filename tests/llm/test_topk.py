"""Exact top-k search against comparing all pairs, and its edges."""

import random

import pytest
from pyspark.sql import functions as F

from convspan.llm import topk

COLUMNS = "vec_id long, embedding array<double>"


def plain_top_k(rows, k=10, every=20):
    width = max((len(v) for i, v in rows if i is not None and v is not None), default=0)
    codes = {}
    for i, v in rows:
        if i is not None and v is not None:
            bits = [int(x is not None and (x > 0 or x != x)) for x in v] + [0] * (width - len(v))
            # the order of codes is that of their segments, low bits first; repeated ids here have one code each or the lesser one is all zeros
            codes[i] = min(codes.get(i, bits), bits)
    out = set()
    for q in (i for i in codes if i % every == 0):
        near = sorted((sum(a != b for a, b in zip(codes[q], codes[i])), i) for i in codes if i != q)[:k]
        out |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    return out


def found(frame, **more):
    return {tuple(r) for r in topk.top_k(frame, **more).collect()}


@pytest.mark.parametrize("width,n", [(1, 30), (7, 50), (64, 400), (65, 300), (150, 200)])
def test_all_widths_against_all_pairs(spark, width, n):
    rng = random.Random(width)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]
    assert found(spark.createDataFrame(rows, COLUMNS)) == plain_top_k(rows)


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    rng = random.Random(2)
    rows = [(i, [1.0] * 64 if i % 3 == 0 else [rng.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(600)]
    assert found(spark.createDataFrame(rows, COLUMNS)) == plain_top_k(rows)


def test_far_and_near_ties(spark):
    """Queries whose neighbours are all alike, or nowhere near: ties go to the least id."""
    rows = [(i, [1.0 if i < 30 else -1.0] * 40) for i in range(45)] + [(60, [1.0, -1.0] * 20)]
    for k in (1, 10, 50):
        assert found(spark.createDataFrame(rows, COLUMNS), k=k) == plain_top_k(rows, k)


def test_large_index_is_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)]) for i in range(200)]
    monkeypatch.setattr(topk, "BROADCAST_ROWS", 0)
    assert found(spark.createDataFrame(rows, COLUMNS)) == plain_top_k(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0, None]), (20, []), (40, None), (None, [1.0]), (3, [1.0, float("nan"), -0.0, 2.0, 5.0]), (20, []), (5, [float("-inf"), 1.0]), (60, [0.0] * 3), (60, [1.0] * 5), (7, [None])]
    frame = spark.createDataFrame(rows, COLUMNS)
    assert found(frame) == plain_top_k(rows)
    odd = frame.withColumns({c: F.lit("x") for c in ("id", "code", "distance", "rank", "query_id", "key", "label")})
    assert found(odd) == found(frame)
    assert topk.top_k(spark.createDataFrame([], COLUMNS)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], COLUMNS)).count() == 0
    assert found(spark.createDataFrame([(1, [1.0]), (2, [1.0])], COLUMNS)) == set()
