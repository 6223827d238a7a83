"""Optimizer and low-rank-adapter arithmetic on long tables: a tensor is rows (path, i, j, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.functions.exact import exact_sums

@dataclass(frozen=True)
class AdamW:
    beta1: float = 0.9
    beta2: float = 0.95
    epsilon: float = 1e-8
    weight_decay: float = 0.1
    max_grad_norm: float = 1.0

    def __post_init__(self) -> None:
        if not (0 <= self.beta1 < 1 and 0 <= self.beta2 < 1 and self.epsilon > 0 and self.weight_decay >= 0 and self.max_grad_norm > 0):
            raise ValueError("optimizer constants are out of range")


def global_norm(gradients: DataFrame, exact: bool = False) -> DataFrame:
    """One row: norm, the square root of the sum of all gradients' squares; exact: of their exact sum, the same under any partitioning."""
    if exact:
        return exact_sums(gradients, {"squares": F.col("grad") * F.col("grad")}).select(F.sqrt("squares").alias("norm"))
    return gradients.agg(F.sqrt(F.sum(F.col("grad") * F.col("grad"))).alias("norm"))


def clip(gradients: DataFrame, limit: float) -> DataFrame:
    """gradients scaled so that their norm is at most limit; the norm is a one-row table beside them."""
    scale = F.least(F.lit(1.0), F.lit(limit) / (F.col("norm") + 1e-6))
    return gradients.crossJoin(F.broadcast(global_norm(gradients))).withColumn("grad", F.col("grad") * scale).drop("norm")


def adamw_init(weights: DataFrame) -> DataFrame:
    """weights(path, ndim, i, j, value) with moments of zero."""
    return weights.withColumns({"m": F.lit(0.0), "v": F.lit(0.0)})


def adamw_step(state: DataFrame, step: int, rate: float, h: AdamW = AdamW()) -> DataFrame:
    """state(path, ndim, i, j, value, grad, m, v) after a step; only tensors of two dimensions or more decay."""
    moved = clip(state, h.max_grad_norm)
    moved = moved.withColumns({"m": h.beta1 * F.col("m") + (1 - h.beta1) * F.col("grad"), "v": h.beta2 * F.col("v") + (1 - h.beta2) * F.col("grad") * F.col("grad")})
    direction = (F.col("m") / (1 - h.beta1**step)) / (F.sqrt(F.col("v") / (1 - h.beta2**step)) + h.epsilon)
    direction = direction + F.when(F.col("ndim") >= 2, h.weight_decay * F.col("value")).otherwise(0.0)
    return moved.withColumn("value", F.col("value") - rate * direction)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, i, j, value of the products of matrices with the same path."""
    x, y = a.alias("a"), b.alias("b")
    joined = x.join(y, (F.col("a.path") == F.col("b.path")) & (F.col("a.j") == F.col("b.i")))
    return joined.groupBy(F.col("a.path").alias("path"), F.col("a.i").alias("i"), F.col("b.j").alias("j")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("value"))


def small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """The rows, to be broadcast if there are, counted first, at most so many (some 20 MB of numbers)."""
    return F.broadcast(rows) if rows.count() <= most else rows


def merge_lora(weights: DataFrame, a: DataFrame, b: DataFrame, alpha: float, rank: int) -> DataFrame:
    """weights plus (alpha / rank) times a x b, where a path has adapters. b, of rank rows, is the side that is broadcast where it is small."""
    delta = matmul(a, small(b)).withColumnRenamed("value", "delta")
    return weights.join(delta, ["path", "i", "j"], "left").select("path", "i", "j", (F.col("value") + F.coalesce(F.col("delta") * (alpha / rank), F.lit(0.0))).alias("value"))


def parameter_count(*tables: DataFrame) -> DataFrame:
    """path, parameters over all tables."""
    every = tables[0].select("path")
    for t in tables[1:]:
        every = every.unionByName(t.select("path"))
    return every.groupBy("path").agg(F.count(F.lit(1)).alias("parameters"))


def audit_targets(targets: DataFrame, parameters: DataFrame) -> DataFrame:
    """path, fault of adapter targets that are duplicate, unknown, or no matrix, against parameters(path, ndim)."""
    counted = targets.groupBy("path").agg(F.count(F.lit(1)).alias("times")).join(parameters, "path", "left")
    fault = F.when(F.col("times") > 1, "listed twice").when(F.col("ndim").isNull(), "unknown parameter").when(F.col("ndim") != 2, "not a matrix")
    return counted.select("path", fault.alias("fault")).where("fault is not null")
