"""Loss statistics, trajectory comparison and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_entropy(logits: Column, target: Column) -> Column:
    """Log of the summed exponentials less the target's logit, the greatest logit taken out first."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - most))
    return F.log(total) + most - F.element_at(logits, target + 1)


def loss_statistics(rows: DataFrame) -> DataFrame:
    """One row: numerator, denominator, correct_weight, token_count of rows(logits, target, weight).

    The caller has shifted targets by one; ratios are of these sums, never means of ratios.
    """
    logits = F.col("logits").cast("array<double>")
    correct = F.array_position(logits, F.array_max(logits)) - 1 == F.col("target")
    return rows.agg(
        F.sum(cross_entropy(logits, F.col("target")) * F.col("weight")).alias("numerator"), F.sum("weight").alias("denominator"),
        F.sum(F.when(correct, F.col("weight")).otherwise(0.0)).alias("correct_weight"), F.count_if(F.col("weight") > 0).alias("token_count"),
    )


def causal(rows: DataFrame) -> DataFrame:
    """rows(sample_id, pos, logits, token, weight) as rows of loss_statistics: each place's target and weight are the next place's."""
    order = Window.partitionBy("sample_id").orderBy("pos")
    return rows.select("sample_id", "pos", "logits", F.lead("token").over(order).alias("target"), F.lead("weight").over(order).alias("weight")).where("target is not null")


def error_report(errors: DataFrame) -> DataFrame:
    """One row: paired and unpaired steps, greatest and mean errors, and the step of the greatest relative one, of compare_trajectories."""
    paired = lambda c: F.when(F.col("paired"), F.col(c))
    return errors.agg(
        F.count_if("paired").alias("paired_steps"), F.count_if(~F.col("paired")).alias("unpaired_steps"), F.max(paired("abs_error")).alias("most_abs"), F.avg(paired("abs_error")).alias("mean_abs"), F.max(paired("rel_error")).alias("most_rel"),
        F.avg(paired("rel_error")).alias("mean_rel"), F.max_by("step", F.struct(paired("rel_error").alias("e"), -F.col("step"))).alias("worst_step"),
    )


def cosine_rate(step: Column, peak: float, total: int, warmup: int, least: float = 0.1) -> Column:
    """Linear warm-up to peak, then half a cosine down to least * peak."""
    if not 0 <= warmup < total:
        raise ValueError("0 <= warmup < total is required")
    done = F.least(F.greatest((step - warmup) / F.lit(float(total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, peak * step / max(warmup, 1)).otherwise(peak * (least + (1 - least) * 0.5 * (1 + F.cos(math.pi * done))))


def compare_trajectories(a: DataFrame, b: DataFrame) -> DataFrame:
    """step, a, b, abs_error, rel_error, paired of two step-ordered trajectories (step, value); a step only one has is unpaired."""
    both = a.select("step", F.col("value").alias("a")).join(b.select("step", F.col("value").alias("b")), "step", "full_outer")
    error = F.abs(F.col("a") - F.col("b"))
    return both.select("step", "a", "b", error.alias("abs_error"), (error / F.greatest(F.abs("b"), F.lit(1e-12))).alias("rel_error"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"))


def stability(errors: DataFrame) -> DataFrame:
    """One row: steps, early_mean, late_mean, slope of errors(step, rel_error); with an odd count the late half has one more.

    A trajectory has a row per training step, so ranking all of them is small.
    """
    ranked = errors.withColumn("rank", F.row_number().over(Window.orderBy("step"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    early = F.col("rank") <= F.floor(F.col("n") / 2)
    return ranked.agg(F.count(F.lit(1)).alias("steps"), F.avg(F.when(early, F.col("rel_error"))).alias("early_mean"), F.avg(F.when(~early, F.col("rel_error"))).alias("late_mean"), F.regr_slope("rel_error", F.col("step").cast("double")).alias("slope"))
