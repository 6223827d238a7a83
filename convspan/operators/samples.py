"""From spans to finished samples in one call: encode, align, weigh, truncate, and say of every sample what became of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.operators import render, tokens, truncate
from convspan.operators.encoders import WORDS, Encoder

#: What makes a sample fatal, the first of them that holds being its reason.
RENDER, ALIGN, CONFLICT, MISSING = "render", "alignment", "several rules match a token", "a required rule matches no token"
SIDES, BY_WEIGHT = ("reject", "right", "left"), ("loss_aware", "semantic_loss_aware")


@dataclass(frozen=True)
class Policy:
    """How samples are weighed and cut."""

    length: int
    truncation: str = "reject"
    min_context: int = 0
    rules: tuple[tokens.Rule, ...] = tokens.DEFAULT_RULES
    conflict: str = "last_match"

    def __post_init__(self) -> None:
        if self.truncation not in (*SIDES, *BY_WEIGHT):
            raise ValueError(f"unknown truncation {self.truncation!r}")
        if self.length < 2 or not 0 <= self.min_context < self.length:
            raise ValueError("a length is at least 2, and a context not negative and below it")
        if self.min_context and self.truncation not in BY_WEIGHT:
            raise ValueError("a context needs a truncation by weight")


def weighed_tokens(spans: DataFrame, policy: Policy, encoder: Encoder | str = WORDS) -> DataFrame:
    """Tokens of the spans' texts with the fields of their spans, fault, matched and weight.

    Spans with the column boundary_owner say themselves who owns a token that crosses them; else the last one does.
    """
    found = tokens.tokenize(render.documents(spans), encoder)
    found = tokens.align_owned(found, spans) if "boundary_owner" in spans.columns else tokens.align(found, spans).withColumn("fault", F.lit(None).cast("string"))
    return tokens.weigh(found, policy.rules, policy.conflict)


def fatal_reasons(weighed: DataFrame, policy: Policy, refusals: DataFrame | None = None) -> DataFrame:
    """sample_id, fatal_reason of every sample, null for sound ones: refused by a renderer (refusals: sample_id, error), a token without
    an owner, a token that several rules match where that is an error, a required rule without a token; the first of these."""
    missing = F.lit(False)
    for k, rule in enumerate(policy.rules):
        if rule.require_match:
            missing |= ~F.coalesce(F.max(F.array_contains("matched", k)), F.lit(False))
    conflict = F.max((F.size("matched") > 1) & F.col("fault").isNull()) if policy.conflict == "error" else F.lit(False)
    found = weighed.groupBy("sample_id").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("pos"))).alias("fault"), conflict.alias("conflict"), missing.alias("missing"))
    if refusals is not None:
        found = found.join(refusals.select("sample_id", "error"), "sample_id", "full_outer")
    error = F.col("error") if refusals is not None else F.lit(None).cast("string")
    reason = F.when(error.isNotNull(), F.concat(F.lit(f"{RENDER}: "), error)).when(F.col("fault").isNotNull(), F.concat(F.lit(f"{ALIGN}: "), "fault")).when(F.col("conflict"), CONFLICT).when(F.col("missing"), MISSING)
    return found.select("sample_id", reason.alias("fatal_reason"))


def windows(weighed: DataFrame, policy: Policy, units: DataFrame | None = None) -> DataFrame:
    """The window [start, stop) that the policy leaves of each sample, as truncate gives it; stop = start or null: rejected."""
    if policy.truncation in SIDES:
        return truncate.plain(weighed, policy.length, policy.truncation)
    if policy.truncation == "loss_aware":
        return truncate.loss_aware(weighed, policy.length, policy.min_context)
    found = truncate.semantic_loss_aware(weighed, policy.length, units, policy.min_context)
    short = F.col("n_tokens") <= policy.length  # such samples stay whole
    return found.withColumns({"start": F.when(short, 0).otherwise(F.col("start")), "stop": F.when(short, F.col("n_tokens")).otherwise(F.col("stop"))})


def explained(weighed: DataFrame, cut: DataFrame) -> DataFrame:
    """A row for each token inside its sample's window: index there, its own fields and those of its span, the rules that match it and its weight,
    which is 0 for the first; and of the truncation original_length, start and stop, null where nothing was cut."""
    rows = weighed.join(cut.select("sample_id", "n_tokens", F.col("start").alias("from"), F.col("stop").alias("to")), "sample_id").where("pos >= from and pos < to")
    of = lambda c, kind: (F.col(c) if c in weighed.columns else F.lit(None)).cast(kind)
    truncated = F.col("to") - F.col("from") < F.col("n_tokens")
    record = {"original_length": "n_tokens", "cut_start": "from", "cut_stop": "to"}
    return rows.select(
        "sample_id", (F.col("pos") - F.col("from")).cast("long").alias("index"), F.col("token_id").cast("long").alias("id"), "token", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"),
        F.when(F.col("pos") == F.col("from"), 0.0).otherwise(F.col("weight")).alias("weight"), "role", of("part_kind", "string").alias("part_kind"), "span_class", of("message_index", "long").alias("message"), of("part_index", "long").alias("part"),
        F.array_join(F.col("matched").cast("array<string>"), ",").alias("loss_rules"), *[F.when(truncated, F.col(c)).cast("long").alias(n) for n, c in record.items()],
    )


def explain(samples: DataFrame) -> DataFrame:
    """sample_id, value: the tokens of each sample of explained() and its truncation as one JSON text."""
    fields = [c for c in samples.columns if c not in ("sample_id", "original_length", "cut_start", "cut_stop")]
    found = samples.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tokens"), *[F.first(c).alias(c) for c in ("original_length", "cut_start", "cut_stop")])
    record = F.when(F.col("original_length").isNotNull(), F.struct("original_length", F.col("cut_start").alias("start"), F.col("cut_stop").alias("stop")))
    return found.select("sample_id", F.to_json(F.struct("sample_id", record.alias("truncation"), "tokens"), {"ignoreNullFields": "false"}).alias("value"))


def tokenized_samples(spans: DataFrame, policy: Policy, encoder: Encoder | str = WORDS, refusals: DataFrame | None = None, units: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One row for each sample of spans, or of refusals: sample_id, class, fatal_reason, n_tokens, start, stop, selected, total_weight, and of emitted ones
    input_ids, loss_weights, starts, ends, span_indices, arrays as long as the window.

    class is fatal, semantic_rejection, length_rejection, zero_objective or emitted. strict: a fatal sample fails the job with its reason.
    A sample's tokens meet in one task; windows bound the arrays.
    """
    return finished_samples(weighed_tokens(spans, policy, encoder), policy, refusals, units, strict)


def finished_samples(weighed: DataFrame, policy: Policy, refusals: DataFrame | None = None, units: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """tokenized_samples() of weighed_tokens(), which are read three times; callers may write them once before."""
    reasons, cut = fatal_reasons(weighed, policy, refusals), windows(weighed, policy, units)
    inside = weighed.join(cut.select("sample_id", F.col("start").alias("from"), F.col("stop").alias("to")), "sample_id").where("pos >= from and pos < to")
    weight = F.when(F.col("pos") == F.col("from"), 0.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    rows = inside.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("token_id").alias("id"), weight.alias("w"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("span_index").alias("i")))).alias("t"))
    found = reasons.join(cut.select("sample_id", "n_tokens", "start", "stop"), "sample_id", "left").join(rows, "sample_id", "left")
    selected = F.coalesce(F.size(F.filter("t", lambda x: x["w"] > 0)), F.lit(0))
    total = F.aggregate(F.coalesce(F.transform("t", lambda x: x["w"]), F.array().cast("array<double>")), F.lit(0.0), lambda a, w: a + w)
    rejected = "semantic_rejection" if policy.truncation == "semantic_loss_aware" else "length_rejection"
    kind = F.when(F.col("fatal_reason").isNotNull(), "fatal").when(F.coalesce(F.col("stop") <= F.col("start"), F.lit(True)), rejected).when(selected <= 0, "zero_objective").otherwise("emitted")
    if strict:
        kind = F.when(F.col("fatal_reason").isNotNull(), F.raise_error(F.concat(F.lit("sample "), F.col("sample_id").cast("string"), F.lit(": "), "fatal_reason")).cast("string")).otherwise(kind)
    found = found.withColumns({"class": kind, "selected": F.greatest(selected, F.lit(0)).cast("long"), "total_weight": total})
    of = lambda field, kind: F.when(F.col("class") == "emitted", F.transform("t", lambda x: x[field].cast(kind)))
    arrays = {"input_ids": ("id", "int"), "loss_weights": ("w", "float"), "starts": ("s", "long"), "ends": ("e", "long"), "span_indices": ("i", "int")}
    return found.select("sample_id", "class", "fatal_reason", "n_tokens", "start", "stop", "selected", "total_weight", *[of(*x).alias(n) for n, x in arrays.items()])
