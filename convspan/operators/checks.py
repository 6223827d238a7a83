"""Checks on parameters, adapters, replicas of metrics and whole trajectories; every one tells what is at fault row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspan.operators import stats

FLOATING = ("bfloat16", "float16", "float32", "float64")


def at_paths(table: DataFrame, paths: DataFrame, missing: str = "no such parameter") -> DataFrame:
    """The rows of table(path, ...) at each of paths(path), and fault where there is none."""
    found = paths.select("path").join(table.withColumn("__there", F.lit(True)), "path", "left")
    return found.withColumn("fault", F.when(F.col("__there").isNull(), missing)).drop("__there")


def adapters_for(adapters: DataFrame, paths: DataFrame) -> DataFrame:
    """path, parts (the parts of its adapter, in order) and fault of each of paths(path): an adapter has the parts a and b."""
    own = adapters.groupBy("path").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    found = at_paths(own, paths, "no adapter")
    return found.withColumn("fault", F.coalesce("fault", F.when(F.array_join("parts", ",") != "a,b", "an adapter lacks a part")))


def audit_targets(targets: DataFrame, eligible: DataFrame, parameters: DataFrame) -> DataFrame:
    """path, order, fault of each different target: order is its place among all by name, fault the first rule that it breaks.

    Targets are listed once, declared eligible by the model, there, of two dimensions and floating. parameters are (path, ndim, dtype).
    """
    listed = targets.groupBy("path").agg(F.count(F.lit(1)).alias("times"))
    declared = eligible.groupBy("path").agg(F.count(F.lit(1)).alias("declared"))
    found = listed.join(declared, "path", "left").join(parameters.select("path", "ndim", "dtype"), "path", "left")
    fault = F.when(F.col("times") > 1, "listed twice").when(F.col("declared").isNull(), "not eligible").when(F.col("declared") > 1, "declared eligible twice").when(F.col("ndim").isNull(), "no such parameter")
    fault = fault.when(F.col("ndim") != 2, "not a matrix").when(~F.col("dtype").isin(*FLOATING), "not floating")
    # Targets are kernels of one model, thousands at most.
    return found.select("path", F.row_number().over(Window.orderBy("path")).alias("order"), fault.alias("fault"))


def replicated(rows: DataFrame, keys: list[str], devices: int) -> DataFrame:
    """keys, value, fault of rows(keys, replica, value): the value that all devices have alike, each once, or why there is none."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("replica").alias("different"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value").isNull() | F.isnan(F.col("value").cast("double"))).alias("odd"))
    fault = F.when((F.col("n") != devices) | (F.col("different") != devices), "not one value a device").when((F.col("low") != F.col("high")) | (F.col("odd") > 0), "replicas differ")
    return found.select(*keys, F.when(fault.isNull(), F.col("low")).alias("value"), fault.alias("fault"))


def trajectory_gates(a: DataFrame, b: DataFrame, atol: float, rtol: float) -> DataFrame:
    """step, rel_error, within, rate, fault of two trajectories (step, loss, denominator, tokens, rate), b being the reference.

    fault: a step is in one only, weighs or counts other tokens, or moves at another rate; within: the losses differ by at most atol + rtol * |b|.
    """
    one, two = (t.select("step", *[F.col(c).alias(f"{side}_{c}") for c in ("loss", "denominator", "tokens", "rate")]) for t, side in ((a, "a"), (b, "b")))
    both = one.join(two, "step", "full_outer")
    rates = F.abs(F.col("a_rate") - F.col("b_rate")) <= F.greatest(F.greatest(F.abs("a_rate"), F.abs("b_rate")) * 1e-6, F.lit(1e-12))
    fault = F.when(F.col("a_loss").isNull() | F.col("b_loss").isNull(), "a step is in one trajectory only").when(F.abs(F.col("a_denominator") - F.col("b_denominator")) > 1e-5, "denominators differ").when(F.col("a_tokens") != F.col("b_tokens"), "token counts differ").when(~rates, "rates differ")
    error = F.abs(F.col("a_loss") - F.col("b_loss"))
    return both.select("step", (error / F.greatest(F.abs("b_loss"), F.lit(1e-12))).alias("rel_error"), (error <= atol + rtol * F.abs("b_loss")).alias("within"), F.col("a_rate").alias("rate"), fault.alias("fault"))


def trajectory_verdict(a: DataFrame, b: DataFrame, atol: float, rtol: float, most_slope: float, most_growth: float, start_step: int | None = None) -> DataFrame:
    """One row: steps, faults, outside (steps beyond the tolerance), most_rel, start_step, slope, growth, passed.

    Slope and growth (late mean less early mean) of the relative error count from start_step on, by default the step after the first with a
    rate above 0; without such a step nothing passes.
    """
    gates = trajectory_gates(a, b, atol, rtol)
    totals = gates.agg(
        F.count(F.lit(1)).alias("steps"), F.count("fault").alias("faults"), F.count_if(~F.coalesce("within", F.lit(False))).alias("outside"), F.max("rel_error").alias("most_rel"),
        (F.lit(start_step) if start_step is not None else (F.min(F.when(F.col("rate") > 0, F.col("step"))) + 1)).cast("long").alias("start_step"),
    )
    late = stats.stability(gates.crossJoin(F.broadcast(totals.select("start_step"))).where("step >= start_step and rel_error is not null").select("step", "rel_error"))
    found = totals.crossJoin(F.broadcast(late.select("slope", (F.col("late_mean") - F.col("early_mean")).alias("growth"))))
    passed = (F.col("faults") == 0) & (F.col("outside") == 0) & F.coalesce((F.col("slope") <= most_slope) & (F.col("growth") <= most_growth), F.lit(False))
    return found.withColumn("passed", passed)
