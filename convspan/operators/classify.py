"""One class per source row, and the counters that the classes add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("adapter_error", "fatal", "semantic_rejection", "length_rejection", "zero_objective", "emitted")


def classify(samples: DataFrame) -> DataFrame:
    """samples(sample_id, reason, missing_match, semantic_rejected, length_rejected, selected) with class.

    A required rule that matches nothing is fatal; rejections come before the objective is looked at.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = F.when(F.col("reason").isNotNull(), "adapter_error").when(yes("missing_match"), "fatal").when(yes("semantic_rejected"), "semantic_rejection")
    found = found.when(yes("length_rejected"), "length_rejection").when(F.coalesce("selected", F.lit(0)) == 0, "zero_objective").otherwise("emitted")
    return samples.withColumn("class", found)


def counters(classified: DataFrame) -> DataFrame:
    """One row: rows_seen, a count for each class, and truncation sums, which rows dropped later still add to."""
    truncated = F.col("truncated") & F.col("class").isin("zero_objective", "emitted")
    return classified.agg(
        F.count(F.lit(1)).alias("rows_seen"), *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES],
        F.count_if(truncated).alias("truncated_samples"), F.coalesce(F.sum(F.when(truncated, F.col("n_tokens") - F.col("kept_tokens"))), F.lit(0)).alias("tokens_dropped"),
    )


def stream_counters(classified: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of a stream's epoch per keys, of rows with policy, reason, class, truncated, n_tokens, kept_tokens, relaxed,
    kept_exchanges and all_ and kept numbers of selected tokens, weights and messages.

    Rejected rows add to no sum of a truncation; reasons, at most 240 characters each, are listed with their numbers. One aggregation.
    """
    cut = F.col("truncated") & F.col("class").isin("zero_objective", "emitted")
    whole = cut & (F.col("policy") == "semantic_loss_aware")
    count = lambda c, name: F.count_if(c).alias(name)
    of = lambda name: count(F.col("class") == name, "")
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    reasons = classified.where("class = 'adapter_error'").groupBy(*keys, F.left("reason", F.lit(240)).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    reasons = reasons.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("rows").cast("string")))), ",").alias("adapter_errors_by_reason"))
    found = classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_seen"), F.count(F.lit(1)).alias("rows_seen_in_epoch"), of("emitted").alias("rows_emitted"), of("adapter_error").alias("adapter_errors"), of("length_rejection").alias("length_rejections"),
        of("semantic_rejection").alias("semantic_truncation_rejections"), of("zero_objective").alias("zero_objective"), count(cut, "truncated_samples"), count(whole, "semantic_truncated_samples"),
        total(cut, F.col("n_tokens") - F.col("kept_tokens")).alias("tokens_truncated"), total(cut, F.col("all_selected") - F.col("selected")).alias("selected_tokens_truncated"), total(cut, F.col("all_weight") - F.col("kept_weight")).cast("double").alias("selected_weight_truncated"),
        total(whole, F.col("all_messages") - F.col("kept_messages")).alias("messages_truncated"), total(cut, F.col("kept_exchanges")).cast("long").alias("tool_atomic_units_retained"), count(cut & F.coalesce("relaxed", F.lit(False)), "context_constraint_relaxations"), F.lit(1).cast("long").alias("epochs"),
    )
    return found.join(reasons, keys, "left").withColumn("adapter_errors_by_reason", F.coalesce("adapter_errors_by_reason", F.lit("")))
