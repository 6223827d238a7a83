"""Matrices in tiles: rows (path, bi, bj, height, width, values), a tile's numbers row after row in one array.

A product joins tiles by the block that they share and multiplies them as arrays, so what is shuffled are tiles, not a row for each pair of
numbers. A side is broadcast only if the sum of its sizes, counted first, is below a bound; beyond it the join shuffles both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers along a tile's edge, bytes up to which a side is broadcast, and tiles that are added in one group.
EDGE, BROADCAST_BYTES, FAN_IN = 64, 32 << 20, 64


def of_vectors(rows: DataFrame, edge: int = EDGE) -> DataFrame:
    """Tiles of rows(path, i, vector): row i of the matrix path is the vector; rows count from 0 without gaps, vectors have one length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("vector") - 1) / edge).cast("int")), lambda b: F.struct(b.alias("bj"), F.slice("vector", b * edge + 1, F.lit(edge)).cast("array<double>").alias("chunk")))
    cut = rows.where(F.size("vector") > 0).select("path", F.col("i").cast("long").alias("i"), F.explode(blocks).alias("b")).select("path", F.floor(F.col("i") / edge).alias("bi"), F.col("b.bj").cast("long").alias("bj"), "i", F.col("b.chunk").alias("chunk"))
    found = cut.groupBy("path", "bi", "bj").agg(F.array_sort(F.collect_list(F.struct("i", "chunk"))).alias("x"))
    return found.select("path", "bi", "bj", F.size("x").alias("height"), F.size(F.col("x")[0]["chunk"]).alias("width"), F.flatten(F.transform("x", lambda r: r["chunk"])).alias("values"))


def of_numbers(rows: DataFrame, edge: int = EDGE) -> DataFrame:
    """Tiles of a whole matrix in rows (path, i, j, value)."""
    cut = rows.groupBy("path", F.floor(F.col("i") / edge).alias("bi"), F.floor(F.col("j") / edge).alias("bj"))
    found = cut.agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("v")))).alias("x"), (F.max("i") - F.min("i") + 1).cast("int").alias("height"), (F.max("j") - F.min("j") + 1).cast("int").alias("width"))
    whole = F.assert_true(F.size("x") == F.col("height") * F.col("width"), F.lit("a tile lacks numbers or has some twice")).isNull()
    return found.where(whole).select("path", "bi", "bj", "height", "width", F.transform("x", lambda v: v["v"]).alias("values"))


def numbers(tiles: DataFrame, edge: int = EDGE) -> DataFrame:
    """path, i, j, value of tiles."""
    rows = tiles.select("path", "bi", "bj", "width", F.posexplode("values").alias("k", "value"))
    return rows.select("path", (F.col("bi") * edge + F.floor(F.col("k") / F.col("width"))).alias("i"), (F.col("bj") * edge + F.col("k") % F.col("width")).alias("j"), "value")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _product(a: pd.Series, b: pd.Series, inner: pd.Series) -> pd.Series:
    return pd.Series([(np.asarray(x).reshape(-1, k) @ np.asarray(y).reshape(k, -1)).ravel() for x, y, k in zip(a, b, inner, strict=True)])


def small(tiles: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The tiles, to be broadcast if their numbers, counted first, are of at most so many bytes."""
    size = tiles.agg(F.sum(F.size("values").cast("long") * 8)).first()[0] or 0
    return F.broadcast(tiles) if size <= most else tiles


def _added(parts: DataFrame) -> DataFrame:
    """Sums of tiles at one place, in groups of FAN_IN at most, level by level, in the order of their inner blocks."""
    keys = ["path", "bi", "bj", "height", "width"]
    most = parts.agg(F.max("inner")).first()[0]
    levels = 1
    while most is not None and most >= FAN_IN**levels:
        levels += 1
    for _ in range(levels):
        parts = parts.withColumn("inner", F.floor(F.col("inner") / FAN_IN)).withColumn("at", F.col("inner"))
        listed = parts.groupBy(*keys, "inner").agg(F.array_sort(F.collect_list(F.struct("at", "values"))).alias("x"))
        added = F.aggregate(F.slice("x", F.lit(2), F.size("x")), F.get("x", F.lit(0))["values"], lambda s, t: F.zip_with(s, t["values"], lambda p, q: p + q))
        parts = listed.select(*keys, "inner", added.alias("values"))
    return parts.drop("inner")


def matmul(a: DataFrame, b: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Tiles of the products of matrices with the same path; b is the side that is broadcast where it is small."""
    x, y = a.alias("a"), small(b, most).alias("b")
    joined = x.join(y, (F.col("a.path") == F.col("b.path")) & (F.col("a.bj") == F.col("b.bi")))
    values = _product("a.values", "b.values", "a.width")
    parts = joined.select(F.col("a.path").alias("path"), F.col("a.bi").alias("bi"), F.col("b.bj").alias("bj"), F.col("a.height").alias("height"), F.col("b.width").alias("width"), F.col("a.bj").alias("inner"), values.alias("values"))
    return _added(parts)


def add(a: DataFrame, b: DataFrame, scale: float = 1.0) -> DataFrame:
    """Tiles of a + scale * b; where b has no tile a stays."""
    other = b.select("path", "bi", "bj", F.col("values").alias("more"))
    both = F.zip_with("values", "more", lambda p, q: p + q * scale)
    return a.join(other, ["path", "bi", "bj"], "left").select("path", "bi", "bj", "height", "width", F.when(F.col("more").isNull(), F.col("values")).otherwise(both).alias("values"))


def linear(x: DataFrame, w: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """Tiles of x w + scale (x a) b."""
    return add(matmul(x, w), matmul(matmul(x, a), b), scale)


def merge(w: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """Tiles of w + scale a b; paths without adapters stay as they are."""
    return add(w, matmul(a, b), scale)
