"""Queries of the checks on parameters, replicas and trajectories, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspan.operators import checks
from convspan.sources import tables


def audit_lora_targets(spark, sf_dir):
    """Targets of a kernel for each label of the vectors, of which all but every sixth are damaged in some way."""
    e = tables.table(spark, sf_dir, "embeddings").select("label").distinct().select("label", F.concat(F.lit("layers["), F.col("label").cast("string"), F.lit("].kernel")).alias("path"))
    kind = F.col("label") % 6
    targets = e.select("path").unionByName(e.where(kind == 1).select("path"))
    parameters = e.where(kind != 5).select("path", F.when(kind == 3, 3).otherwise(2).alias("ndim"), F.when(kind == 4, "int8").otherwise("bfloat16").alias("dtype"))
    found = checks.audit_targets(targets, e.where(kind != 2).select("path"), parameters)
    return found.select("path", F.col("order").cast("long"), "fault")


def adapter_paths(spark, sf_dir):
    """Adapters of the labels' kernels by their paths, some without a part or at all."""
    e = tables.table(spark, sf_dir, "embeddings").select("label").distinct().select("label", F.concat(F.lit("layers["), F.col("label").cast("string"), F.lit("].kernel")).alias("path"))
    adapters = e.where("label % 3 <> 2").select("path", F.explode(F.when(F.col("label") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("part"))
    return checks.adapters_for(adapters, e).select("path", F.array_join("parts", ",").alias("parts"), "fault")


def replicated_metrics(spark, sf_dir):
    """A day's greatest event value as four devices tell it; some days one is silent, or tells another."""
    e = tables.table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp("ts") / 86400).cast("long").alias("step")).agg(F.max("value").cast("double").alias("value"))
    rows = e.select("step", "value", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("replica")).where("not (step % 3 = 1 and replica = 2)")
    rows = rows.withColumn("value", F.when((F.col("step") % 5 == 2) & (F.col("replica") == 3), F.col("value") + 1).otherwise(F.col("value")))
    return checks.replicated(rows, ["step"], 4)


def trajectory_verdict(spark, sf_dir):
    """Whether the daily means of even events follow those of odd ones, as two runs of one recipe."""
    e = tables.table(spark, sf_dir, "events").withColumn("step", F.floor(F.unix_timestamp("ts") / 86400).cast("long"))
    days = e.groupBy("step").agg(F.count(F.lit(1)).alias("tokens"))
    first = e.agg(F.min("step").alias("first"))
    value = lambda side: e.where(F.col("event_id") % 2 == side).groupBy("step").agg((F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("loss"))
    run = lambda side: value(side).join(days, "step").crossJoin(F.broadcast(first)).select("step", "loss", F.col("tokens").cast("double").alias("denominator"), "tokens", F.when(F.col("step") < F.col("first") + 2, 0.0).otherwise(0.1).alias("rate"))
    found = checks.trajectory_verdict(run(0), run(1), 1.0, 0.2, 0.01, 0.1)
    return found.select("steps", "faults", "outside", F.round("most_rel", 4).alias("most_rel"), "start_step", F.round("slope", 5).alias("slope"), F.round("growth", 4).alias("growth"), "passed")


def queries() -> dict:
    return {f.__name__: f for f in (audit_lora_targets, adapter_paths, replicated_metrics, trajectory_verdict)}


LABELS = "e AS (SELECT DISTINCT label, 'layers[' || label || '].kernel' AS path FROM embeddings)"
SQL = {
    "audit_lora_targets": f"WITH {LABELS} SELECT path, row_number() OVER (ORDER BY path) AS \"order\", CASE label % 6 WHEN 1 THEN 'listed twice' WHEN 2 THEN 'not eligible' WHEN 3 THEN 'not a matrix' WHEN 4 THEN 'not floating' WHEN 5 THEN 'no such parameter' END AS fault FROM e",
    "adapter_paths": f"WITH {LABELS} SELECT path, CASE label % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' END AS parts, CASE label % 3 WHEN 1 THEN 'an adapter lacks a part' WHEN 2 THEN 'no adapter' END AS fault FROM e",
    "replicated_metrics": "WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, CAST(max(value) AS DOUBLE) AS value FROM events GROUP BY 1) SELECT step, CASE WHEN step % 3 <> 1 AND step % 5 <> 2 THEN value END AS value, CASE WHEN step % 3 = 1 THEN 'not one value a device' WHEN step % 5 = 2 THEN 'replicas differ' END AS fault FROM d",
    "trajectory_verdict": "WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, event_id % 2 AS side, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS loss FROM events GROUP BY 1, 2), f AS (SELECT min(step) AS first FROM d), "
                          "g AS (SELECT coalesce(a.step, b.step) AS step, abs(a.loss - b.loss) / greatest(abs(b.loss), 1e-12) AS rel, abs(a.loss - b.loss) <= 1 + 0.2 * abs(b.loss) AS within, a.loss IS NULL OR b.loss IS NULL AS alone, a.loss IS NOT NULL AND coalesce(a.step, b.step) >= first + 2 AS moves FROM (SELECT * FROM d WHERE side = 0) a FULL JOIN (SELECT * FROM d WHERE side = 1) b ON a.step = b.step, f), "
                          "t AS (SELECT count(*) AS steps, count(*) FILTER (alone) AS faults, count(*) FILTER (NOT coalesce(within, false)) AS outside, max(rel) AS most_rel, min(step) FILTER (moves) + 1 AS start_step FROM g), "
                          "r AS (SELECT g.step, rel, row_number() OVER (ORDER BY g.step) AS k, count(*) OVER () AS n FROM g, t WHERE g.step >= start_step AND rel IS NOT NULL), s AS (SELECT regr_slope(rel, step) AS slope, avg(rel) FILTER (k > n // 2) - avg(rel) FILTER (k <= n // 2) AS growth FROM r) "
                          "SELECT steps, faults, outside, round(most_rel, 4) AS most_rel, start_step, round(slope, 5) AS slope, round(growth, 4) AS growth, faults = 0 AND outside = 0 AND coalesce(slope <= 0.01 AND growth <= 0.1, false) AS passed FROM t, s",
}
