"""Exact sums and tiled matrices against whole numbers of any size and numpy."""

import math
import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspan.functions.exact import exact_sums
from convspan.operators import params, tiles


def test_exact_sums_under_any_partitioning(spark):
    rng = random.Random(4)
    data = [(k % 3, rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-300, 300)) for k in range(3000)] + [(3, x) for x in (1e16, 1.0, -1e16, 1e-30)] + [(4, 5e-324), (4, 5e-324), (5, 1.7e308), (5, 1.7e308), (6, 0.1), (6, -0.1)]
    want = {}
    for key in range(7):
        try:
            want[key] = float(sum((Fraction(x) for k, x in data if k == key), Fraction(0)))
        except OverflowError:
            want[key] = math.inf
    table = spark.createDataFrame(data, "k int, x double")
    for n in (1, 7, 64):
        assert {r.k: r.s for r in exact_sums(table.repartition(n), {"s": F.col("x")}, ["k"]).collect()} == want
    assert want[3] == 1.0 and want[4] == 1e-323 and want[6] == 0.0
    assert len({p[0] + p[1] + p[2] for p in permutations((1e16, 1.0, -1e16))}) > 1  # in plain sums the order shows


def test_exact_sums_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    table = spark.createDataFrame([("null", None), ("inf", inf), ("inf", 1.0), ("minus", -inf), ("both", inf), ("both", -inf), ("nan", nan), ("nan", 2.0), ("some", None), ("some", 2.5)], "k string, x double")
    got = {r.k: (r.a, r.b) for r in exact_sums(table, {"a": F.col("x"), "b": F.lit(1.0)}, ["k"]).collect()}
    assert got["null"] == (None, 1.0) and got["inf"] == (inf, 2.0) and got["minus"][0] == -inf and got["some"] == (2.5, 2.0) and math.isnan(got["both"][0]) and math.isnan(got["nan"][0])
    assert exact_sums(table.where("false"), {"a": F.col("x")}).collect()[0].a is None
    grads = spark.createDataFrame([(0.1,)] * 100, "grad double")
    assert params.global_norm(grads.repartition(5), exact=True).first().norm == math.sqrt(float(sum([Fraction(0.1 * 0.1)] * 100)))


def table_of(spark, path, m):
    return spark.createDataFrame([(path, i, [float(x) for x in row]) for i, row in enumerate(m)], "path string, i long, vector array<double>")


def matrix(tiled, edge, shape):
    found = np.full(shape, np.nan)
    for r in tiles.numbers(tiled, edge).collect():
        found[r.i, r.j] = r.value
    return found


@pytest.mark.parametrize("edge,most", [(3, 0), (4, 1 << 20), (64, 0)])
def test_layers_like_numpy(spark, edge, most):
    rng = np.random.default_rng(edge)
    x, w, a, b = rng.normal(size=(10, 7)), rng.normal(size=(7, 5)), rng.normal(size=(7, 2)), rng.normal(size=(2, 5))
    t = lambda m: tiles.of_vectors(table_of(spark, "p", m), edge)
    assert np.allclose(matrix(tiles.matmul(t(x), t(w), most), edge, (10, 5)), x @ w)
    assert np.allclose(matrix(tiles.linear(t(x), t(w), t(a), t(b), 0.5), edge, (10, 5)), x @ w + 0.5 * (x @ a) @ b)
    merged = tiles.merge(t(w).unionByName(t(w).withColumn("path", F.lit("q"))), t(a), t(b), 2.0)
    assert np.allclose(matrix(merged.where("path = 'p'"), edge, (7, 5)), w + 2 * a @ b) and np.allclose(matrix(merged.where("path = 'q'"), edge, (7, 5)), w)
    again = tiles.of_numbers(tiles.numbers(t(x), edge), edge)
    assert np.array_equal(matrix(again, edge, (10, 7)), x)
    with pytest.raises(Exception, match="lacks numbers"):
        tiles.of_numbers(tiles.numbers(t(x), edge).where("i <> 1 or j <> 1"), edge).collect()


def test_many_inner_blocks(spark, monkeypatch):
    """Sums of more tiles than one group takes go level by level."""
    monkeypatch.setattr(tiles, "FAN_IN", 3)
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(4, 40)), rng.normal(size=(40, 3))
    t = lambda m: tiles.of_vectors(table_of(spark, "p", m), 2)
    assert np.allclose(matrix(tiles.matmul(t(x), t(w)), 2, (4, 3)), x @ w)


def test_sides_are_broadcast_by_size(spark):
    t = tiles.of_vectors(table_of(spark, "p", np.ones((4, 4))), 2)
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(t.join(tiles.small(t).alias("b"), "path")) and "strategy=broadcast" not in plan(t.join(tiles.small(t, 8).alias("b"), "path"))
