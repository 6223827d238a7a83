"""Queries on whole samples: what each of their tokens is, why samples fail, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspan.operators import render, samples, tokens
from convspan.plans.oracle import MESSAGES, _windows
from convspan.sources import tables
from convspan.sources.stage import staged

LENGTH = 64
#: Rules of which two meet in a fourth message of an assistant, and one needs a system message.
STRICT = samples.Policy(LENGTH, "right", 0, (tokens.Rule(2.0, {"role": "assistant"}), tokens.Rule(0.5, {"span_class": "content", "message_index": 3}), tokens.Rule(1.0, {"role": "system"}, require_match=True)), "error")


def explain_tokens(spark, sf_dir):
    """Every token that truncation leaves of every conversation, with its span, its rules and what was cut."""
    policy = samples.Policy(LENGTH, "loss_aware")
    w = staged(samples.weighed_tokens(render.get_renderer("qwen2_5_math")(tables.message_table(tables.table(spark, sf_dir, "conversations"))), policy))
    return samples.explained(w, samples.windows(w, policy)).withColumn("role", F.coalesce("role", F.lit("none"))).drop("part_kind", "part")


def _flawed(spark, sf_dir):
    """(spans, refusals): one sample in seven has no user, one tokens that cross spans whose owners differ."""
    m = tables.message_table(tables.table(spark, sf_dir, "conversations"))
    m = tables.dealt(staged(m.withColumn("role", F.when((F.col("sample_id") % 7 == 0) & (F.col("role") == "user"), "assistant").otherwise(F.col("role")))))
    header = render.span("role_header", F.concat(F.lit("<|"), "role", F.lit("|>")))
    spans = render.spans_of(m, [header, render.span("content", F.col("text"), F.when(F.col("role") == "assistant", 1.0).otherwise(0.0)), render.span("turn_end", F.lit("\n"))], None)
    owner = F.when((F.col("sample_id") % 7 == 1) & (F.col("span_class") == "content"), "left").otherwise("right")
    return spans.withColumn("boundary_owner", owner), render.plain_refusals(m)


def fatal_causes(spark, sf_dir):
    """Class of every sample under strict rules, and why it is fatal."""
    spans, refusals = _flawed(spark, sf_dir)
    found = samples.finished_samples(staged(samples.weighed_tokens(tables.dealt(staged(spans)), STRICT)), STRICT, refusals)
    return found.select("sample_id", "class", "fatal_reason", "n_tokens", "selected", "total_weight")


def queries() -> dict:
    return {f.__name__: f for f in (explain_tokens, fatal_causes)}


#: A word that touches a header belongs to the content after it; header and content meet in one token unless white space begins the content.
FLAWED = MESSAGES + r""",
f AS (SELECT sample_id, message_index, CASE WHEN sample_id % 7 = 0 AND role = 'user' THEN 'assistant' ELSE role END AS role, text FROM m),
refused AS (SELECT sample_id, CASE WHEN count(*) FILTER (role = 'user' AND NOT (starts_with(trim(text), '<tool_response>') AND ends_with(trim(text), '</tool_response>'))) = 0 THEN 'at least one user query is required' WHEN bool_or(role = 'system' AND message_index > 0) THEN 'system message must be first' END AS error FROM f GROUP BY 1),
raw AS (SELECT sample_id, message_index, role, 'role_header' AS class, '<|' || role || '|>' AS text, message_index * 3 AS ord FROM f UNION ALL SELECT sample_id, message_index, role, 'content', text, message_index * 3 + 1 FROM f UNION ALL SELECT sample_id, message_index, role, 'turn_end', chr(10), message_index * 3 + 2 FROM f),
spans AS (SELECT *, sample_id % 7 = 1 AND class = 'content' AS lefty, CAST(sum(length(text)) OVER (PARTITION BY sample_id ORDER BY ord) AS BIGINT) AS r FROM raw WHERE length(text) > 0),
docs AS (SELECT sample_id, string_agg(text, '' ORDER BY ord) AS text FROM spans GROUP BY 1),
t0 AS (SELECT sample_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token FROM (SELECT sample_id, regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+') AS l FROM docs)),
t AS (SELECT *, CAST(sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) AS BIGINT) AS e FROM t0),
met AS (SELECT t.sample_id, pos, count(*) AS n, count(*) FILTER (lefty) AS lefts, arg_max(role, ord) AS role, arg_max(class, ord) AS class, arg_max(message_index, ord) AS i FROM t JOIN spans s ON s.sample_id = t.sample_id AND e - length(token) < s.r AND e > s.r - length(s.text) GROUP BY 1, 2),
x AS (SELECT *, n > 1 AND lefts BETWEEN 1 AND n - 1 AS lost, role = 'assistant' AS r0, class = 'content' AND i = 3 AS r1, role = 'system' AS r2 FROM met),
y AS (SELECT sample_id, pos, lost, r0 AND r1 AND NOT lost AS clash, r2, CASE WHEN pos = 0 THEN 0 WHEN lost THEN 0 WHEN r0 THEN 2 WHEN r1 THEN 0.5 WHEN r2 THEN 1 WHEN class = 'content' AND role = 'assistant' THEN 1 ELSE 0 END * CASE WHEN r0 AND r1 THEN 0 ELSE 1 END AS weight FROM x),
s AS (SELECT sample_id, count(*) AS n_tokens, bool_or(lost) AS lost, bool_or(clash) AS clash, bool_or(r2 AND NOT lost) AS found, count(*) FILTER (pos < 64 AND weight > 0) AS selected, sum(weight) FILTER (pos < 64) AS total FROM y GROUP BY 1),
told AS (SELECT s.*, CASE WHEN error IS NOT NULL THEN 'render: ' || error WHEN lost THEN 'alignment: a token crosses spans without one owner' WHEN clash THEN 'several rules match a token' WHEN NOT found THEN 'a required rule matches no token' END AS fatal_reason FROM s JOIN refused USING (sample_id))"""

SQL = {
    "explain_tokens": f"WITH {_windows(0)} SELECT w.sample_id, CAST(w.pos - b.start AS BIGINT) AS index, token_id AS id, token, CAST(s AS BIGINT) AS start_char, e AS end_char, CAST(CASE WHEN w.pos = b.start THEN 0 ELSE weight END AS DOUBLE) AS weight, coalesce(role, 'none') AS role, span_class, CAST(message_index AS BIGINT) AS message, "
                      "CASE WHEN role = 'assistant' AND span_class IN ('assistant_end', 'role_header') THEN '0,2' WHEN role = 'assistant' AND span_class = 'content' THEN '0,1' ELSE '0' END AS loss_rules, CASE WHEN n_tokens > 64 THEN n_tokens END AS original_length, CASE WHEN n_tokens > 64 THEN b.start END AS cut_start, CASE WHEN n_tokens > 64 THEN b.stop END AS cut_stop "
                      "FROM w JOIN best b ON w.sample_id = b.sample_id AND w.pos >= b.start AND w.pos < b.stop",
    "fatal_causes": f"WITH {FLAWED} SELECT sample_id, CASE WHEN fatal_reason IS NOT NULL THEN 'fatal' WHEN selected = 0 THEN 'zero_objective' ELSE 'emitted' END AS class, fatal_reason, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(selected AS BIGINT) AS selected, CAST(total AS DOUBLE) AS total_weight FROM told",
}
