"""Queries on conversations with tool exchanges, typed content blocks and renderer rules, each beside its DuckDB twin.

The conversations of the tables have no tools, so exchanges are put into them by a rule that both engines know: an assistant message
whose sample and index add up to a multiple of 3 becomes two calls, their results and the answer; samples are damaged by their number
modulo 11, so that every rule is broken by some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspan.operators import classify, render, tokens, tool_units, truncate
from convspan.plans.oracle import MESSAGES
from convspan.sources import tables
from convspan.sources.stage import staged

LENGTH, CONTEXT = 96, 4
EMPTY = "array<string>"


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, message_index, role, text, n_messages, call_ids, result_ids."""
    m = tables.message_table(tables.table(spark, sf_dir, "conversations"))
    kind = F.col("sample_id") % 11
    name = lambda k: F.when(kind == 4, F.lit(f"c_{k}")).when(kind == 5, F.lit("d")).when((kind == 9) & F.lit(k == 1), F.lit("")).otherwise(F.concat(F.lit("c"), F.col("message_index").cast("string"), F.lit(f"_{k}")))
    none = F.array().cast(EMPTY)
    one = lambda at, role, text, calls, results: F.struct(F.lit(at).alias("at"), role.alias("role"), text.alias("text"), calls.alias("call_ids"), results.alias("result_ids"))
    parts = F.array(
        one(0, F.when(kind == 6, "user").otherwise("assistant"), F.lit("look up two things"), F.array(name(0), name(1)), none),
        one(1, F.lit("tool"), F.lit("first found"), none, F.when(kind == 2, F.array(F.lit("x"))).when(kind == 8, F.array(name(0), name(1))).otherwise(F.array(name(1)))),
        one(2, F.lit("tool"), F.lit("second found"), none, F.array(name(0))), one(3, F.lit("assistant"), F.col("text"), none, none),
    )
    dropped = F.when(kind == 1, 2).when(kind == 3, 3).when(kind == 7, 0).otherwise(-1)
    parts = F.filter(parts, lambda p: p["at"] != dropped)
    whole = F.array(one(0, F.col("role"), F.col("text"), none, none))
    rows = m.select("sample_id", "message_index", F.explode(F.when((F.col("role") == "assistant") & ((F.col("sample_id") + F.col("message_index")) % 3 == 0), parts).otherwise(whole)).alias("p"))
    by = Window.partitionBy("sample_id")
    rows = rows.withColumn("index", F.row_number().over(by.orderBy("message_index", "p.at")) - 1)
    return rows.select("sample_id", F.col("index").alias("message_index"), "p.role", "p.text", F.count(F.lit(1)).over(by).alias("n_messages"), "p.call_ids", "p.result_ids")


TOOLS = MESSAGES + """,
e AS (SELECT *, role = 'assistant' AND (sample_id + message_index) % 3 = 0 AS split, sample_id % 11 AS kind,
    CASE sample_id % 11 WHEN 4 THEN 'c_0' WHEN 5 THEN 'd' ELSE 'c' || message_index || '_0' END AS one, CASE sample_id % 11 WHEN 4 THEN 'c_1' WHEN 5 THEN 'd' WHEN 9 THEN '' ELSE 'c' || message_index || '_1' END AS two FROM m),
x AS (SELECT sample_id, message_index, 0 AS sub, role, text, CAST([] AS VARCHAR[]) AS calls, CAST([] AS VARCHAR[]) AS results FROM e WHERE NOT split
  UNION ALL SELECT sample_id, message_index, 0, CASE WHEN kind = 6 THEN 'user' ELSE 'assistant' END, 'look up two things', [one, two], [] FROM e WHERE split AND kind <> 7
  UNION ALL SELECT sample_id, message_index, 1, 'tool', 'first found', [], CASE kind WHEN 2 THEN ['x'] WHEN 8 THEN [one, two] ELSE [two] END FROM e WHERE split
  UNION ALL SELECT sample_id, message_index, 2, 'tool', 'second found', [], [one] FROM e WHERE split AND kind <> 1
  UNION ALL SELECT sample_id, message_index, 3, 'assistant', text, [], [] FROM e WHERE split AND kind <> 3),
tm AS (SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY message_index, sub) - 1 AS BIGINT) AS i, role, text, calls, results, count(*) OVER (PARTITION BY sample_id) AS n FROM x)"""

#: By plain look-ups: earlier ids by a scan of the sample, the pending calls by the nearest call before.
AUDIT = TOOLS + """,
p AS (SELECT a.*, coalesce(lag(len(calls) > 0 OR role = 'tool') OVER w, false) AS goes_on, i + 1 = n AS final,
    coalesce((SELECT len(list_intersect(flatten(list(b.calls)), a.calls)) FROM tm b WHERE b.sample_id = a.sample_id AND b.i < a.i), 0) > 0 AS called_before,
    a.role = 'tool' AND coalesce((SELECT len(list_intersect(flatten(list(b.results)), a.results)) FROM tm b WHERE b.sample_id = a.sample_id AND b.i < a.i AND b.role = 'tool'), 0) > 0 AS answered_before,
    (SELECT max(b.i) FROM tm b WHERE b.sample_id = a.sample_id AND b.i < a.i AND len(b.calls) > 0) AS call_at FROM tm a WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
q AS (SELECT p.*, c.calls AS pending, (SELECT count(*) FROM tm b WHERE b.sample_id = p.sample_id AND b.i > p.call_at AND b.i < p.i AND b.role = 'tool') AS answered FROM p LEFT JOIN tm c ON c.sample_id = p.sample_id AND c.i = p.call_at),
f AS (SELECT *, CASE WHEN len(calls) > 0 AND role <> 'assistant' THEN 'a tool call is outside an assistant message' WHEN list_contains(calls, '') THEN 'a tool call has no id'
    WHEN len(list_distinct(calls)) < len(calls) THEN 'duplicate call ids in a message' WHEN called_before THEN 'a call id is used again'
    WHEN role = 'tool' AND (len(results) <> 1 OR list_contains(results, '')) THEN 'a tool result has not exactly one id' WHEN role = 'tool' AND NOT goes_on THEN 'a result belongs to no call'
    WHEN role = 'tool' AND NOT coalesce(list_contains(pending, results[1]), false) THEN 'a result has an unknown id' WHEN answered_before THEN 'duplicate results of a call'
    WHEN goes_on AND role <> 'tool' AND answered < len(pending) THEN 'a call lacks its result' WHEN goes_on AND role <> 'tool' AND role <> 'assistant' THEN 'a tool exchange has no final answer'
    WHEN final AND len(calls) > 0 THEN 'a call lacks its result' WHEN final AND role = 'tool' AND answered + 1 < len(pending) THEN 'a call lacks its result' WHEN final AND role = 'tool' THEN 'a tool exchange has no final answer' END AS fault FROM q),
bad AS (SELECT sample_id, arg_min(fault, i) AS reason FROM f WHERE fault IS NOT NULL GROUP BY 1),
u AS (SELECT sample_id, i, CAST(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id ORDER BY i) - 1 AS BIGINT) AS unit, goes_on OR len(calls) > 0 AS exchange FROM f WHERE sample_id NOT IN (SELECT sample_id FROM bad)),
units AS (SELECT *, bool_or(exchange) OVER (PARTITION BY sample_id, unit) AS tool_exchange FROM u)"""


def tool_unit_rejects(spark, sf_dir):
    return tool_units.rejections(tool_messages(spark, sf_dir))


def tool_unit_messages(spark, sf_dir):
    found = tool_units.units_of_messages(tool_messages(spark, sf_dir))
    return found.select("sample_id", F.col("message_index").cast("long"), F.col("unit").cast("long"), "tool_exchange")


def tool_links(spark, sf_dir):
    """Calls without results, results without calls, and both, per kind."""
    found = tool_units.links(tool_messages(spark, sf_dir))
    kind = F.when(F.col("call_message").isNull(), "result without call").when(F.col("result_message").isNull(), "call without result").otherwise("linked")
    return found.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("result_message") - F.col("call_message")).cast("long").alias("distance"))


def _transcript(messages: DataFrame) -> DataFrame:
    """Spans of a plain transcript; every second sample has a list of tools before it."""
    assistant = F.col("role") == "assistant"
    each = [render.span("role_header", F.concat(F.lit("<|"), "role", F.lit("|> "))), render.span("content", F.col("text"), F.when(assistant, 1.0).otherwise(0.0)), render.span("turn_end", F.lit("\n"), F.when(assistant, 0.5).otherwise(0.0))]
    return render.spans_of(messages, each, render.span("tool_preamble", F.when(F.col("sample_id") % 2 == 0, "<tools> lookup </tools>\n").otherwise("")))


def _tool_tokens(messages: DataFrame) -> DataFrame:
    spans = _transcript(messages)
    return tokens.weigh(tokens.align(tokens.tokenize(render.documents(spans)), spans), ())


def _tool_windows(messages: DataFrame, w: DataFrame, context: int = CONTEXT) -> DataFrame:
    return truncate.semantic_loss_aware(w, LENGTH, tool_units.units_of_messages(messages), context)


def _staged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Messages and their weighed tokens, each made once for all that reads them."""
    messages = tables.dealt(staged(tool_messages(spark, sf_dir)))
    return messages, tables.dealt(staged(_tool_tokens(messages)), "token")


TOKENS = AUDIT + r""",
raw AS (SELECT sample_id, NULL AS i, NULL AS role, 'tool_preamble' AS class, CASE WHEN sample_id % 2 = 0 THEN '<tools> lookup </tools>' || chr(10) ELSE '' END AS text, 0.0 AS dw, -1 AS ord FROM tm WHERE i = 0
  UNION ALL SELECT sample_id, i, role, 'role_header', '<|' || role || '|> ', 0.0, i * 10 FROM tm UNION ALL SELECT sample_id, i, role, 'content', text, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END, i * 10 + 1 FROM tm
  UNION ALL SELECT sample_id, i, role, 'turn_end', chr(10), CASE WHEN role = 'assistant' THEN 0.5 ELSE 0.0 END, i * 10 + 2 FROM tm),
spans AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY sample_id ORDER BY ord) AS BIGINT) AS r FROM raw WHERE length(text) > 0), docs AS (SELECT sample_id, string_agg(text, '' ORDER BY ord) AS text FROM spans GROUP BY 1),
t0 AS (SELECT sample_id, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+'), 1) - 1 AS pos, unnest(regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+')) AS token FROM docs),
t AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) AS BIGINT) AS e FROM t0),
tw AS (SELECT t.sample_id, pos, i, class, CASE WHEN pos = 0 THEN 0.0 ELSE dw END AS weight FROM t JOIN spans ON t.sample_id = spans.sample_id AND spans.r - length(spans.text) <= t.e - 1 AND t.e - 1 < spans.r),
carried AS (SELECT *, coalesce(last_value(i IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY pos), 0) AS block FROM tw),
ub AS (SELECT c.sample_id, unit, bool_or(tool_exchange) AS tool_exchange, min(pos) AS start, max(pos) + 1 AS stop, min(block) AS low, max(block) AS high FROM carried c JOIN units ON units.sample_id = c.sample_id AND units.i = c.block GROUP BY 1, 2),
totals AS (SELECT sample_id, sum(weight) AS weight, bool_or(class = 'tool_preamble') AS preamble, count(*) AS n_tokens, count(*) FILTER (weight > 0) AS selected FROM tw WHERE sample_id IN (SELECT sample_id FROM ub) GROUP BY 1),
runs AS (SELECT a.sample_id, a.start, b.stop, a.low, b.high, b.unit - a.unit + 1 AS kept_units, (SELECT count(*) FROM ub k WHERE k.sample_id = a.sample_id AND k.unit BETWEEN a.unit AND b.unit AND k.tool_exchange) AS kept_exchanges, a.unit > 0 AS later
  FROM ub a JOIN ub b ON a.sample_id = b.sample_id AND a.unit <= b.unit AND b.stop - a.start <= 96),
summed AS (SELECT runs.sample_id, start, stop, low, high, kept_units, kept_exchanges, coalesce(sum(tw.weight), 0) AS score, count(*) FILTER (tw.weight > 0) AS kept_selected, coalesce(max(pos) FILTER (tw.weight > 0), -1) AS latest, min(pos) FILTER (tw.weight > 0) AS earliest
  FROM runs JOIN totals USING (sample_id) LEFT JOIN tw ON tw.sample_id = runs.sample_id AND pos > start AND pos < stop WHERE NOT (preamble AND later AND kept_exchanges > 0) GROUP BY ALL),
scored AS (SELECT *, coalesce(earliest - start, 0) AS context FROM summed),
allowed AS (SELECT scored.*, row_number() OVER (PARTITION BY sample_id ORDER BY context >= 4 DESC, score DESC, latest DESC, context DESC, stop - start DESC, start) AS k FROM scored JOIN totals USING (sample_id) WHERE totals.weight = 0 OR score > 0),
wins AS (SELECT totals.sample_id, totals.n_tokens, totals.weight AS all_weight, totals.selected, (SELECT count(*) FROM ub WHERE ub.sample_id = totals.sample_id) AS n_units, (SELECT count(*) FROM ub WHERE ub.sample_id = totals.sample_id AND tool_exchange) AS n_exchanges,
  start, stop, low, high, score, context, context < 4 AS relaxed, kept_units, kept_exchanges, kept_selected FROM totals LEFT JOIN (SELECT * FROM allowed WHERE k = 1) a USING (sample_id))"""


def trunc_semantic_tools(spark, sf_dir):
    return _tool_windows(*_staged(spark, sf_dir)).select("sample_id", "start", "stop", F.col("first_block").cast("long"), F.col("last_block").cast("long"), "score", F.col("context").cast("long"), "relaxed", F.col("kept_units").cast("long"), F.col("kept_exchanges").cast("long"))


def _records(spark, sf_dir) -> DataFrame:
    messages, w = _staged(spark, sf_dir)
    return truncate.records(w, _tool_windows(messages, w), "semantic_loss_aware", LENGTH, CONTEXT)


def truncation_records(spark, sf_dir):
    """Every record with its lists as text, and the fault that the checks find (none)."""
    found = staged(_records(spark, sf_dir))
    told = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.join(truncate.record_faults(found), "sample_id", "left").select(
        "sample_id", "policy", "original_length", "start", "stop", "original_selected", "retained_selected", "original_weight", "retained_weight", F.col("retained_context").cast("long"), "context_satisfied",
        told("original_messages"), told("retained_messages"), told("dropped_messages"), *[F.col(c).cast("long") for c in ("original_units", "retained_units", "original_exchanges", "retained_exchanges")], "fault",
    )


POLICIES = ("reject", "right", "semantic_loss_aware")


def _policies(spark, sf_dir) -> DataFrame:
    """Every sample under every policy, with class and what it keeps.

    Samples of a multiple of 13 have a role that no adapter knows; under "right" a rule is required that matches system messages only.
    """
    messages, w = _staged(spark, sf_dir)
    found = _tool_windows(messages, w).select("sample_id", F.col("start").alias("s"), F.col("stop").alias("e"), "relaxed", "kept_exchanges", F.lit(True).alias("sound"))
    rows = truncate.plain(w, LENGTH, "right").select("sample_id", "n_tokens").join(found, "sample_id", "left")
    rows = rows.join(messages.groupBy("sample_id").agg(F.count_if(F.col("role") == "system").alias("systems")), "sample_id")
    rows = rows.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES)))).withColumn("truncated", F.col("n_tokens") > LENGTH)
    is_ = {p: F.col("policy") == p for p in POLICIES}
    whole = is_["semantic_loss_aware"] & F.col("truncated")
    rows = rows.withColumns({
        "from": F.when(whole, F.col("s")).otherwise(0), "to": F.when(whole, F.col("e")).when(is_["right"], F.least("n_tokens", F.lit(LENGTH))).when(is_["reject"] & F.col("truncated"), 0).otherwise(F.col("n_tokens")),
        "reason": F.when(F.col("sample_id") % 13 == 0, "unknown message role"), "missing_match": is_["right"] & (F.col("systems") == 0), "length_rejected": is_["reject"] & F.col("truncated"),
        "semantic_rejected": is_["semantic_loss_aware"] & (F.col("sound").isNull() | F.col("truncated") & F.col("s").isNull()), "relaxed": whole & F.coalesce("relaxed", F.lit(False)), "kept_exchanges": F.when(whole, F.coalesce("kept_exchanges", F.lit(0))).otherwise(0),
    })
    inside = (F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("to"))
    counted = inside & (F.col("pos") > F.col("from")) & (F.col("weight") > 0)
    kept = w.join(rows.select("sample_id", "policy", "from", "to"), "sample_id").groupBy("sample_id", "policy").agg(
        F.count_if(F.col("weight") > 0).alias("all_selected"), F.count_if(counted).alias("selected"), F.sum("weight").alias("all_weight"), F.coalesce(F.sum(F.when(counted, F.col("weight"))), F.lit(0.0)).alias("kept_weight"),
        F.count_distinct("message_index").alias("all_messages"), F.count_distinct(F.when(inside, F.col("message_index"))).alias("kept_messages"),
    )
    return classify.classify(rows.join(kept, ["sample_id", "policy"]).withColumn("kept_tokens", F.col("to") - F.col("from")))


def classify_policies(spark, sf_dir):
    return _policies(spark, sf_dir).select("policy", "sample_id", "class")


def stream_counters_all(spark, sf_dir):
    """All counters of a stream of one epoch, for each policy."""
    return classify.stream_counters(staged(_policies(spark, sf_dir)), ["policy"])


POLICY_CLASSES = TOKENS + """,
facts AS (SELECT sample_id, count(*) AS n_tokens, count(*) FILTER (weight > 0) AS all_selected, sum(weight) AS all_weight, count(DISTINCT i) AS all_messages FROM tw GROUP BY 1),
bounds AS (SELECT sample_id, 'reject' AS policy, 0 AS s, CASE WHEN n_tokens <= 96 THEN n_tokens ELSE 0 END AS e, false AS semantic, n_tokens > 96 AS length, false AS relaxed, 0 AS kept_exchanges FROM facts
  UNION ALL SELECT sample_id, 'right', 0, least(n_tokens, 96), false, false, false, 0 FROM facts
  UNION ALL SELECT f.sample_id, 'semantic_loss_aware', CASE WHEN f.n_tokens > 96 THEN start ELSE 0 END, CASE WHEN f.n_tokens > 96 THEN stop ELSE f.n_tokens END, w.sample_id IS NULL OR (f.n_tokens > 96 AND start IS NULL), false, relaxed, kept_exchanges FROM facts f LEFT JOIN wins w USING (sample_id)),
kept AS (SELECT b.policy, b.sample_id, any_value(b.s) AS s, any_value(b.e) AS e, any_value(semantic) AS semantic, any_value(length) AS length, any_value(relaxed) AS relaxed, any_value(kept_exchanges) AS kept_exchanges, count(*) FILTER (pos > s AND pos < e AND weight > 0) AS selected, coalesce(sum(weight) FILTER (pos > s AND pos < e), 0) AS kept_weight,
  count(DISTINCT i) FILTER (pos >= s AND pos < e) AS kept_messages FROM bounds b JOIN tw USING (sample_id) GROUP BY 1, 2),
cls AS (SELECT kept.*, n_tokens, all_selected, all_weight, all_messages, CASE WHEN sample_id % 13 = 0 THEN 'adapter_error' WHEN policy = 'right' AND NOT EXISTS (SELECT 1 FROM tm WHERE tm.sample_id = kept.sample_id AND role = 'system') THEN 'fatal' WHEN semantic THEN 'semantic_rejection' WHEN length THEN 'length_rejection' WHEN selected = 0 THEN 'zero_objective' ELSE 'emitted' END AS class FROM kept JOIN facts USING (sample_id))"""
CUT = "n_tokens > 96 AND class IN ('zero_objective', 'emitted')"


def tags_and_parts(spark, sf_dir):
    """Weights by rules on all fields of a span: tags, kinds and numbers of parts, call ids and tool names."""
    spans = _transcript(tool_messages(spark, sf_dir)).withColumns({
        "part_kind": F.when(F.col("role") == "tool", "tool_result").when(F.col("span_class") == "content", "text"), "part_index": F.when(F.col("span_class") == "content", 0), "call_id": F.when(F.col("role") == "tool", F.lit("c")), "tool_name": F.when(F.col("role") == "tool", F.lit("lookup")),
        "tags": F.when(F.col("message_index") % 2 == 0, F.array(F.lit("even"), "span_class")).otherwise(F.array("span_class")),
    })
    w = tokens.weigh(tokens.align(tokens.tokenize(render.documents(spans)), spans), TAG_RULES)
    return w.groupBy("sample_id").agg(*[F.count_if(F.array_contains("matched", k)).alias(f"rule_{k}") for k in range(len(TAG_RULES))], F.sum("weight").alias("total_weight"))


TAG_RULES = (tokens.Rule(0.25, {"tags": "even"}), tokens.Rule(0.5, {"part_kind": ["tool_result", "code"], "tool_name": "lookup"}), tokens.Rule(2.0, {"tags": ["content", "other"], "part_index": 0, "role": "assistant"}), tokens.Rule(0.75, {"call_id": "c", "span_class": "content", "message_index": [1, 2, 3]}))


def alignment_faults(spark, sf_dir):
    """Tokens that cross spans, and such as have no characters or lie outside the text, of samples with damaged ranges."""
    spans = _transcript(tool_messages(spark, sf_dir))
    t = tokens.tokenize(render.documents(spans))
    shift = F.when(F.col("pos") == 3, F.when(F.col("sample_id") % 5 == 1, 10_000_000).otherwise(0)).otherwise(0)
    t = t.withColumns({"end": F.when((F.col("sample_id") % 5 == 2) & (F.col("pos") == 3), F.col("start")).otherwise(F.col("end") + shift), "start": F.col("start") + shift})
    return tokens.alignment_faults(t, spans).groupBy("fault").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("sample_id").alias("samples"))


def token_faults(spark, sf_dir):
    """Rules of tokenized samples that samples break, each damaged in one way by its number."""
    kind, at = F.col("sample_id") % 6, F.col("pos")
    w = _tool_tokens(tool_messages(spark, sf_dir)).where(~((kind == 1) & (at == 2)))
    w = w.withColumns({"end": F.when((kind == 2) & (at == 4), F.col("start")).otherwise(F.col("end")), "weight": F.when((kind == 3) & (at % 50 == 7), -F.col("weight") - 1).when((kind == 4) & (at == 0), 1.0).otherwise(F.col("weight"))})
    return tokens.faults(w).groupBy("fault").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("sample_id").alias("samples"))


def queries() -> dict:
    return {f.__name__: f for f in (tool_unit_rejects, tool_unit_messages, tool_links, trunc_semantic_tools, truncation_records, classify_policies, stream_counters_all, tags_and_parts, alignment_faults, token_faults)}


def _with(body: str, query: str) -> str:
    return f"WITH {body} {query}"


def _list(condition: str) -> str:
    return f"coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM tm WHERE tm.sample_id = wins.sample_id{condition}), '')"


SQL = {
    "token_faults": _with(TOKENS + ", n AS (SELECT sample_id, count(*) AS n FROM tw GROUP BY 1), y AS (SELECT 'positions have gaps' AS fault, sample_id, n - 3 AS k FROM n WHERE sample_id % 6 = 1 AND n > 3 UNION ALL SELECT 'an offset is empty or goes back', sample_id, 1 FROM n WHERE sample_id % 6 = 2 AND n > 4 "
                          "UNION ALL SELECT 'a weight is negative or no number', sample_id, (n - 8) // 50 + 1 FROM n WHERE sample_id % 6 = 3 AND n > 7 UNION ALL SELECT 'a first token has weight', sample_id, 1 FROM n WHERE sample_id % 6 = 4)", "SELECT fault, CAST(sum(k) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS samples FROM y GROUP BY 1"),
    "tool_unit_rejects": _with(AUDIT, "SELECT * FROM bad"),
    "tool_unit_messages": _with(AUDIT, "SELECT sample_id, i AS message_index, unit, tool_exchange FROM units"),
    "tool_links": _with(TOOLS + ", c0 AS (SELECT sample_id, i, unnest(calls) AS id, generate_subscripts(calls, 1) AS k FROM tm), r0 AS (SELECT sample_id, i, unnest(results) AS id, generate_subscripts(results, 1) AS k FROM tm), c AS (SELECT *, row_number() OVER (PARTITION BY sample_id, id ORDER BY i, k) AS nth FROM c0), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, id ORDER BY i, k) AS nth FROM r0)",
                        "SELECT CASE WHEN c.i IS NULL THEN 'result without call' WHEN r.i IS NULL THEN 'call without result' ELSE 'linked' END AS kind, CAST(count(*) AS BIGINT) AS links, CAST(sum(r.i - c.i) AS BIGINT) AS distance FROM c FULL JOIN r USING (sample_id, id, nth) GROUP BY 1"),
    "trunc_semantic_tools": _with(TOKENS, "SELECT sample_id, start, stop, CAST(low AS BIGINT) AS first_block, CAST(high AS BIGINT) AS last_block, CAST(score AS DOUBLE) AS score, CAST(context AS BIGINT) AS context, relaxed, CAST(kept_units AS BIGINT) AS kept_units, CAST(kept_exchanges AS BIGINT) AS kept_exchanges FROM wins"),
    "truncation_records": _with(TOKENS, "SELECT sample_id, 'semantic_loss_aware' AS policy, n_tokens AS original_length, start, stop, selected AS original_selected, kept_selected AS retained_selected, CAST(all_weight AS DOUBLE) AS original_weight, CAST(score AS DOUBLE) AS retained_weight, CAST(context AS BIGINT) AS retained_context, NOT relaxed AS context_satisfied, "
                                f"{_list('')} AS original_messages, {_list(' AND tm.i BETWEEN low AND high')} AS retained_messages, {_list(' AND tm.i NOT BETWEEN low AND high')} AS dropped_messages, CAST(n_units AS BIGINT) AS original_units, CAST(kept_units AS BIGINT) AS retained_units, CAST(n_exchanges AS BIGINT) AS original_exchanges, CAST(kept_exchanges AS BIGINT) AS retained_exchanges, CAST(NULL AS VARCHAR) AS fault FROM wins WHERE n_tokens > 96 AND start IS NOT NULL"),
    "classify_policies": _with(POLICY_CLASSES, "SELECT policy, sample_id, class FROM cls"),
    "stream_counters_all": _with(POLICY_CLASSES, "SELECT policy, CAST(count(*) AS BIGINT) AS rows_seen, CAST(count(*) AS BIGINT) AS rows_seen_in_epoch, CAST(count(*) FILTER (class = 'emitted') AS BIGINT) AS rows_emitted, CAST(count(*) FILTER (class = 'adapter_error') AS BIGINT) AS adapter_errors, "
                                 "CASE WHEN count(*) FILTER (class = 'adapter_error') > 0 THEN 'unknown message role=' || count(*) FILTER (class = 'adapter_error') ELSE '' END AS adapter_errors_by_reason, CAST(count(*) FILTER (class = 'length_rejection') AS BIGINT) AS length_rejections, CAST(count(*) FILTER (class = 'semantic_rejection') AS BIGINT) AS semantic_truncation_rejections, "
                                 f"CAST(count(*) FILTER (class = 'zero_objective') AS BIGINT) AS zero_objective, CAST(count(*) FILTER ({CUT}) AS BIGINT) AS truncated_samples, CAST(count(*) FILTER ({CUT} AND policy = 'semantic_loss_aware') AS BIGINT) AS semantic_truncated_samples, CAST(coalesce(sum(n_tokens - (e - s)) FILTER ({CUT}), 0) AS BIGINT) AS tokens_truncated, "
                                 f"CAST(coalesce(sum(all_selected - selected) FILTER ({CUT}), 0) AS BIGINT) AS selected_tokens_truncated, CAST(coalesce(sum(all_weight - kept_weight) FILTER ({CUT}), 0) AS DOUBLE) AS selected_weight_truncated, CAST(coalesce(sum(all_messages - kept_messages) FILTER ({CUT} AND policy = 'semantic_loss_aware'), 0) AS BIGINT) AS messages_truncated, "
                                 f"CAST(coalesce(sum(kept_exchanges) FILTER ({CUT}), 0) AS BIGINT) AS tool_atomic_units_retained, CAST(count(*) FILTER ({CUT} AND relaxed) AS BIGINT) AS context_constraint_relaxations, CAST(1 AS BIGINT) AS epochs FROM cls GROUP BY 1"),
    "tags_and_parts": _with(TOKENS + ", o AS (SELECT tw.*, tm.role FROM tw LEFT JOIN tm ON tm.sample_id = tw.sample_id AND tm.i = tw.i), g AS (SELECT sample_id, pos, coalesce(i % 2 = 0, false) AS r0, coalesce(role = 'tool', false) AS r1, class = 'content' AND role = 'assistant' AS r2, coalesce(role = 'tool' AND class = 'content' AND i IN (1, 2, 3), false) AS r3, weight FROM o)",
                            "SELECT sample_id, CAST(count(*) FILTER (r0) AS BIGINT) AS rule_0, CAST(count(*) FILTER (r1) AS BIGINT) AS rule_1, CAST(count(*) FILTER (r2) AS BIGINT) AS rule_2, CAST(count(*) FILTER (r3) AS BIGINT) AS rule_3, CAST(sum(CASE WHEN pos = 0 THEN 0 WHEN r3 THEN 0.75 WHEN r2 THEN 2 WHEN r1 THEN 0.5 WHEN r0 THEN 0.25 ELSE weight END) AS DOUBLE) AS total_weight FROM g GROUP BY 1"),
    "alignment_faults": _with(TOKENS + ", y AS (SELECT t.sample_id, t.pos, CASE WHEN t.pos = 3 AND t.sample_id % 5 = 2 THEN 'a token has no characters' WHEN t.pos = 3 AND t.sample_id % 5 = 1 THEN 'a token lies outside the text' WHEN (SELECT count(*) FROM spans WHERE spans.sample_id = t.sample_id AND t.e > spans.r - length(spans.text) AND t.e - length(token) < spans.r) > 1 THEN 'a token crosses spans' END AS fault FROM t)",
                              "SELECT fault, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT sample_id) AS BIGINT) AS samples FROM y WHERE fault IS NOT NULL GROUP BY 1"),
}
