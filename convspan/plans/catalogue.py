"""The registered queries; their DuckDB twins are in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspan.operators import adapters, batch, classify, params, render, stats, tokens, truncate
from convspan.plans import audits, dialects, encoding, epochs, exchanges, matrices, oracle, records, runs, table_calls, tensors
from convspan.sources import tables
from convspan.streaming import cursor

Query = Callable[[SparkSession, str], DataFrame]
LENGTH, CONTEXT, SEED = 64, 8, 17
TEMPLATE = "qwen2_5_math"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.message_table(tables.table(spark, sf_dir, "conversations"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rows of the messages dialect, with the first user text as the prompt."""
    m = tables.table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = m.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    user = F.filter("messages", lambda x: x["role"] == "user")
    return rows.withColumns({"prompt": F.get(user, F.lit(0))["content"], "prompt_id": F.col("conv_id").cast("string")})


def _spans(spark: SparkSession, sf_dir: str, name: str = TEMPLATE) -> DataFrame:
    return render.get_renderer(name)(_messages(spark, sf_dir))


def _aligned(spark: SparkSession, sf_dir: str, pattern: str = tokens.WORDS, owner: str = "right") -> DataFrame:
    spans = _spans(spark, sf_dir)
    return tokens.align(tokens.tokenize(render.documents(spans), pattern), spans, owner)


def _weighed(spark: SparkSession, sf_dir: str, rules: tuple = tokens.DEFAULT_RULES, conflict: str = "last_match") -> DataFrame:
    return tokens.weigh(_aligned(spark, sf_dir), rules, conflict)


def _role() -> Column:
    return F.coalesce("role", F.lit("none")).alias("role")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role: tokens, selected tokens and total weight of all conversations."""
    return _weighed(spark, sf_dir).groupBy(_role()).agg(F.count(F.lit(1)).alias("token_count"), F.count_if(F.col("weight") > 0).alias("selected_tokens"), F.sum("weight").alias("total_weight"))


def adapt_messages_roles(spark, sf_dir):
    found = adapters.messages_adapter(_rows(spark, sf_dir)).where("reason is null")
    m = found.select("conv_id", F.posexplode("messages").alias("at", "m"))
    return m.select("conv_id", F.col("at").cast("long").alias("message_index"), "m.role", F.size("m.parts").cast("long").alias("parts"), F.length(F.col("m.parts")[0]["value"]).cast("long").alias("chars"))


def adapt_ultrachat_reject(spark, sf_dir):
    found = adapters.ultrachat_200k_adapter(_rows(spark, sf_dir))
    return found.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def adapter_reason_counts(spark, sf_dir):
    return adapters.reason_counts(adapters.ultrachat_200k_adapter(_rows(spark, sf_dir)))


def adapt_prompt_completion(spark, sf_dir):
    answer = F.get(F.filter("messages", lambda x: x["role"] == "assistant"), F.lit(0))["content"]
    rows = _rows(spark, sf_dir).select("conv_id", "prompt", answer.alias("completion"))
    found = adapters.prompt_completion_adapter(rows)
    text = lambda k: F.col("messages")[k]["parts"][0]["value"]
    return found.where("reason is null").select("conv_id", F.sha2(text(0), 256).alias("user_sha"), F.sha2(text(1), 256).alias("assistant_sha"))


def adapt_sharegpt_alias(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in (("user", "human"), ("assistant", "gpt"), ("system", "system")) for x in pair])
    other = F.transform("messages", lambda m: F.struct(names[m["role"]].alias("from"), m["content"].alias("value")))
    found = adapters.sharegpt_adapter(_rows(spark, sf_dir).select(F.col("conv_id").alias("id"), other.alias("conversations")))
    return found.where("reason is null").select(F.explode("messages").alias("m")).groupBy("m.role").agg(F.count(F.lit(1)).alias("messages"))


def sample_id_fallback(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    given = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))
    return c.select("conv_id", adapters.sample_id("repo", "main", "default", "train", F.col("conv_id"), given).alias("sample_id"))


def _text_query(name: str) -> Query:
    def run(spark, sf_dir):
        text = render.documents(_spans(spark, sf_dir, name))
        return text.select("sample_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha"), render.template_hash(name, 1, F.col("text")).alias("template_hash"))

    return run


def render_span_inventory(spark, sf_dir):
    return _spans(spark, sf_dir, "olmo2_instruct").groupBy("span_class", _role()).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.length("text")).alias("chars"))


def span_ranges(spark, sf_dir):
    return render.ranges(_spans(spark, sf_dir)).select("sample_id", F.col("span_index").cast("long"), F.col("left").alias("left_char"), F.col("right").alias("right_char"))


def _owner_query(pattern: str) -> Query:
    def run(spark, sf_dir):
        return _aligned(spark, sf_dir, pattern).groupBy("sample_id", "span_class", _role()).agg(F.count(F.lit(1)).alias("token_count"), F.sum(F.col("token_id").cast("long")).alias("ids"))

    return run


def alignment_left_vs_right(spark, sf_dir):
    left, right = (_aligned(spark, sf_dir, owner=o).select("sample_id", "pos", F.col("span_index").alias(o)) for o in ("left", "right"))
    return left.join(right, ["sample_id", "pos"]).where("left <> right").groupBy("sample_id").agg(F.count(F.lit(1)).alias("differing"))


def _weights_query(conflict: str, rules: tuple) -> Query:
    def run(spark, sf_dir):
        w = _weighed(spark, sf_dir, rules, conflict)
        return w.groupBy("sample_id").agg(F.count_if(F.col("weight") > 0).alias("selected"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"), F.count_if(F.size("matched") > 1).alias("conflicts"))

    return run


def rule_match_counts(spark, sf_dir):
    return tokens.match_counts(_weighed(spark, sf_dir))


def require_match_failures(spark, sf_dir):
    needed = [k for k, r in enumerate(tokens.DEFAULT_RULES) if r.require_match]
    found = tokens.match_counts(_weighed(spark, sf_dir))
    return found.where(" or ".join(f"rule_{k} = 0" for k in needed)).select("sample_id")


def zero_objective(spark, sf_dir):
    return truncate.sizes(_weighed(spark, sf_dir)).where("selected = 0").select("sample_id", "n_tokens")


def _plain_query(side: str) -> Query:
    return lambda spark, sf_dir: truncate.plain(_weighed(spark, sf_dir), LENGTH, side)


def _loss_aware_query(context: int) -> Query:
    return lambda spark, sf_dir: truncate.loss_aware(_weighed(spark, sf_dir), LENGTH, context)


def message_blocks(spark, sf_dir):
    b = truncate.message_blocks(_weighed(spark, sf_dir))
    return b.select("sample_id", F.col("block").cast("long"), "start", "stop", "weight", "selected")


def trunc_semantic(spark, sf_dir):
    found = truncate.semantic_loss_aware(_weighed(spark, sf_dir), LENGTH)
    return found.select("sample_id", "start", "stop", F.col("first_block").cast("long"), F.col("last_block").cast("long"), "score")


def _classified(spark, sf_dir):
    """Every sample with its window, and whether a required rule matches none of its tokens, from one reading of the tokens."""
    rows = adapters.ultrachat_200k_adapter(_rows(spark, sf_dir)).select(F.col("conv_id").alias("sample_id"), "reason")
    needed = [k for k, r in enumerate(tokens.DEFAULT_RULES) if r.require_match]
    missing = F.lit(False)
    for k in needed:
        missing |= ~F.max(F.array_contains("matched", k)).over(Window.partitionBy("sample_id"))
    window = truncate.loss_aware(_weighed(spark, sf_dir).withColumn("missing_match", missing), LENGTH, keep=("missing_match",))
    found = rows.join(window, "sample_id", "left")
    found = found.withColumns({"semantic_rejected": F.lit(False), "length_rejected": F.lit(False), "truncated": F.col("n_tokens") > LENGTH, "kept_tokens": F.col("stop") - F.col("start")})
    return classify.classify(found)


def classify_rows(spark, sf_dir):
    return _classified(spark, sf_dir).select("sample_id", "class")


def stream_counters(spark, sf_dir):
    return classify.counters(_classified(spark, sf_dir))


def _order(spark, sf_dir, epoch=0):
    return batch.shuffled(tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id")).distinct(), SEED, epoch)


def shuffle_rank_split(spark, sf_dir):
    return _order(spark, sf_dir).select("sample_id", "position", batch.rank_of(F.col("position"), 4).alias("rank"))


def microbatch_index(spark, sf_dir):
    return _order(spark, sf_dir).select("sample_id", *[c.cast("long").alias(n) for n, c in batch.index_columns(F.col("position"), 2, 2, 2, 2).items()])


def tape_replay_slices(spark, sf_dir):
    found = _order(spark, sf_dir).select("sample_id", *[c.cast("long").alias(n) for n, c in batch.index_columns(F.col("position"), 1, 2, 2, 4).items()])
    return found.groupBy("step", "process").agg(F.count(F.lit(1)).alias("rows"), F.sum("sample_id").alias("ids"))


def _padded(spark, sf_dir):
    return batch.padded(truncate.within_loss_aware(_weighed(spark, sf_dir), LENGTH, keep=("token_id",)), None, LENGTH)


def padded_batches(spark, sf_dir):
    rows = _padded(spark, sf_dir).select("sample_id", F.posexplode(F.arrays_zip("input_ids", "attention_mask", "loss_weights")).alias("at", "x"))
    return rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("length"), F.sum(F.col("x.input_ids").cast("long") * (F.col("at") + 1)).alias("ids"), F.count_if("x.attention_mask").alias("real"), F.sum(F.col("x.loss_weights").cast("double")).alias("weight"))


def tape_validation(spark, sf_dir):
    """Faults of a tape with one row in four damaged."""
    rows = _padded(spark, sf_dir).withColumn("item", F.col("sample_id").cast("int")).withColumn("step", F.lit(0))
    damaged = rows.withColumn("loss_weights", F.when(F.col("item") % 4 == 1, F.transform("loss_weights", lambda w: -w - 1)).otherwise(F.col("loss_weights")))
    return batch.tape_faults(damaged, LENGTH).select(F.col("item").cast("long"), "fault")


def resume_cursor(spark, sf_dir):
    """What rank 1 of 4 sees after 3 rows of its first epoch, up to the epoch's end."""
    samples = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id")).distinct()
    size = samples.count()
    left = max(-(-(size - 1) // 4) - 3, 0)
    found = cursor.take(samples, cursor.Cursor(0, 3, 1, 4, SEED, "words"), left, size)
    return found.select("sample_id", "position")


def epoch_rollover(spark, sf_dir):
    """What rank 1 of 4 takes next from 3 rows into its first epoch, as many rows as two epochs and a half have."""
    samples = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id")).distinct()
    size = samples.count()
    per_epoch = max(-(-(size - 1) // 4), 1)
    found = cursor.take(samples, cursor.Cursor(0, 3, 1, 4, SEED, "words"), per_epoch * 5 // 2, size)
    return found.select(F.col("epoch").cast("long"), "sample_id", "position")


def _explained(weighed: DataFrame) -> DataFrame:
    return weighed.select("sample_id", F.col("pos").cast("long"), "token", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "span_class", _role(), "weight")


def explain_all_tokens(spark, sf_dir):
    """The tokens of every conversation."""
    return _explained(_weighed(spark, sf_dir))


def _logits(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("logits"), F.col("label").alias("target"), (F.col("vec_id") % 3).cast("double").alias("weight"))


def loss_statistics(spark, sf_dir):
    s = stats.loss_statistics(_logits(spark, sf_dir))
    return s.select(F.round("numerator", 3).alias("numerator"), "denominator", "correct_weight", "token_count", F.round(F.col("numerator") / F.greatest("denominator", F.lit(1e-12)), 5).alias("loss"))


def loss_ratio_of_sums(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("loss", stats.cross_entropy(F.col("logits").cast("array<double>"), F.col("target")))
    per = rows.groupBy("target").agg(F.sum(F.col("loss") * F.col("weight")).alias("n"), F.sum("weight").alias("d"))
    return per.agg(F.round(F.sum("n") / F.sum("d"), 5).alias("ratio_of_sums"), F.round(F.avg(F.col("n") / F.col("d")), 5).alias("mean_of_ratios"))


def _daily(spark, sf_dir, offset):
    e = tables.table(spark, sf_dir, "events")
    day = F.floor(F.unix_timestamp("ts") / 86400).cast("long")
    return e.where(F.col("event_id") % 2 == offset).groupBy(day.alias("step")).agg((F.sum(F.col("value").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1))).alias("value"))


def _errors(spark, sf_dir):
    return stats.compare_trajectories(_daily(spark, sf_dir, 0), _daily(spark, sf_dir, 1))


def trajectory_compare(spark, sf_dir):
    return _errors(spark, sf_dir).select("step", "paired", F.round("abs_error", 4).alias("abs_error"), F.round("rel_error", 4).alias("rel_error"))


def trajectory_stability(spark, sf_dir):
    s = stats.stability(_errors(spark, sf_dir).where("paired"))
    return s.select("steps", F.round("early_mean", 4).alias("early_mean"), F.round("late_mean", 4).alias("late_mean"), F.round("slope", 5).alias("slope"))


def _state(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    rows = e.select((F.col("vec_id") % 4).alias("path"), F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x"))
    value = F.col("x").cast("double")
    return rows.select("path", F.when(F.col("path") == 0, 1).otherwise(2).alias("ndim"), "i", "j", value.alias("value"), (value * 0.5 - 0.1).alias("grad"), (value * 0.01).alias("m"), (value * value * 0.01).alias("v"))


def grad_norm_clip(spark, sf_dir):
    clipped = params.clip(_state(spark, sf_dir), 1.0).groupBy("path").agg(F.round(F.sqrt(F.sum(F.col("grad") * F.col("grad"))), 6).alias("clipped"))
    norm = params.global_norm(_state(spark, sf_dir)).select(F.round("norm", 4).alias("norm"))
    return clipped.crossJoin(F.broadcast(norm))


def adamw_step(spark, sf_dir):
    moved = params.adamw_step(_state(spark, sf_dir), 3, 0.1)
    return moved.groupBy("path").agg(F.round(F.sum("value"), 4).alias("value"), F.round(F.sum("m"), 4).alias("m"), F.round(F.sum("v"), 4).alias("v"))


def _matrices(spark, sf_dir):
    """W of all vectors, A of its first 4 columns, B of its first 4 rows."""
    e = tables.table(spark, sf_dir, "embeddings")
    w = e.select(F.lit("w").alias("path"), F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).withColumn("value", F.col("x").cast("double")).drop("x")
    return w, w.where("j < 4"), w.where("i < 4")


def _merged(w: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    return params.merge_lora(w, a, b, 8.0, 4).select(F.col("i").cast("long"), F.col("j").cast("long"), F.round("value", 6).alias("value"))


def lora_merge_all(spark, sf_dir):
    """The merge of all vectors."""
    return _merged(*_matrices(spark, sf_dir))


def lora_param_count_all(spark, sf_dir):
    _, a, b = _matrices(spark, sf_dir)
    return params.parameter_count(a, b)


def metrics_rollup(spark, sf_dir):
    w = _weighed(spark, sf_dir)
    return w.rollup("role", "span_class").agg(F.count(F.lit(1)).alias("token_count"), F.sum("weight").alias("total_weight"), F.grouping_id().cast("long").alias("level"))


def queries() -> dict[str, Query]:
    named = [
        adapt_messages_roles, adapt_ultrachat_reject, adapter_reason_counts, adapt_prompt_completion, adapt_sharegpt_alias, sample_id_fallback, render_span_inventory, span_ranges, alignment_left_vs_right, rule_match_counts,
        require_match_failures, zero_objective, message_blocks, trunc_semantic, classify_rows, stream_counters, shuffle_rank_split, microbatch_index, tape_replay_slices, padded_batches, tape_validation,
        resume_cursor, epoch_rollover, explain_all_tokens, loss_statistics, loss_ratio_of_sums, trajectory_compare, trajectory_stability, grad_norm_clip, adamw_step, lora_merge_all, lora_param_count_all, metrics_rollup,
    ]
    return {"flagship": flagship} | {f.__name__: f for f in named} | exchanges.queries() | encoding.queries() | records.queries() | epochs.queries() | dialects.queries() | tensors.queries() | matrices.queries() | runs.queries() | table_calls.queries() | audits.queries() | {
        "render_olmo2_text": _text_query("olmo2_instruct"), "render_math_text": _text_query("qwen2_5_math"), "render_qwen35_text": _text_query("qwen3_5_text"),
        "tokens_char_owner": _owner_query(tokens.CHARACTERS), "tokens_regex_owner": _owner_query(tokens.WORDS),
        "weights_last_match": _weights_query("last_match", tokens.DEFAULT_RULES), "weights_multiply": _weights_query("multiply", tokens.OVERLAPPING_RULES), "weights_conflicts": _weights_query("error", tokens.OVERLAPPING_RULES),
        "trunc_right": _plain_query("right"), "trunc_left": _plain_query("left"), "trunc_reject": _plain_query("reject"), "trunc_loss_aware": _loss_aware_query(0), "trunc_loss_aware_ctx": _loss_aware_query(CONTEXT),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | exchanges.SQL | encoding.SQL | records.SQL | epochs.SQL | dialects.SQL | tensors.SQL | matrices.SQL | runs.SQL | table_calls.SQL | audits.SQL
