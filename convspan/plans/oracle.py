"""DuckDB SQL for the registered queries, written from the semantics and apart from the Spark plans."""

from __future__ import annotations

MESSAGES = "m AS (SELECT conv_id AS sample_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS message_index, role, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"

MATH_SPANS = MESSAGES + r""",
raw AS (
  SELECT sample_id, NULL AS message_index, NULL AS role, 'template_control' AS span_class, CASE WHEN role <> 'system' THEN '<|im_start|>system' || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.<|im_end|>' || chr(10) ELSE '' END AS text, 0.0 AS dw, -1 AS ord FROM m WHERE message_index = 0
  UNION ALL SELECT sample_id, message_index, role, 'role_header', '<|im_start|>' || role || chr(10), 0.0, message_index * 10 FROM m
  UNION ALL SELECT sample_id, message_index, role, 'content', text, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END, message_index * 10 + 1 FROM m
  UNION ALL SELECT sample_id, message_index, role, CASE WHEN role = 'assistant' THEN 'assistant_end' ELSE 'turn_end' END, '<|im_end|>', CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END, message_index * 10 + 2 FROM m
  UNION ALL SELECT sample_id, message_index, role, 'turn_end', chr(10), 0.0, message_index * 10 + 3 FROM m),
spans AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY ord) - 1 AS BIGINT) AS span_index, CAST(sum(length(text)) OVER (PARTITION BY sample_id ORDER BY ord) AS BIGINT) AS r FROM raw WHERE length(text) > 0),
docs AS (SELECT sample_id, string_agg(text, '' ORDER BY ord) AS text FROM spans GROUP BY 1)"""

OLMO_SPANS = MESSAGES + r""",
raw AS (
  SELECT sample_id, NULL AS role, 'bos' AS span_class, '<|endoftext|>' AS text, -1 AS ord FROM m WHERE message_index = 0
  UNION ALL SELECT sample_id, role, 'role_header', '<|' || role || '|>' || chr(10), message_index * 10 FROM m
  UNION ALL SELECT sample_id, role, 'content', text, message_index * 10 + 1 FROM m
  UNION ALL SELECT sample_id, role, CASE WHEN role = 'assistant' THEN 'assistant_end' ELSE 'turn_end' END, CASE WHEN role = 'assistant' THEN '<|endoftext|>' || CASE WHEN message_index + 1 < n THEN chr(10) ELSE '' END ELSE chr(10) END, message_index * 10 + 2 FROM m),
spans AS (SELECT * FROM raw WHERE length(text) > 0),
docs AS (SELECT sample_id, string_agg(text, '' ORDER BY ord) AS text FROM spans GROUP BY 1)"""

QWEN_DOCS = MESSAGES + r""",
q AS (SELECT *, max(CASE WHEN role = 'user' THEN message_index END) OVER (PARTITION BY sample_id) AS lastq FROM m),
docs AS (SELECT sample_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND message_index > lastq THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || '<|im_end|>' || chr(10), '' ORDER BY message_index) AS text FROM q GROUP BY 1)"""


def _tokens(pattern: str) -> str:
    return f"""
t0 AS (SELECT sample_id, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) - 1 AS pos, unnest(regexp_extract_all(text, '{pattern}')) AS token FROM docs),
t AS (SELECT *, CAST('0x' || substr(sha256(token), 1, 7) AS BIGINT) AS token_id, CAST(sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) AS BIGINT) AS e FROM t0),
owned AS (SELECT t.*, e - length(token) AS s, span_index, message_index, span_class, role, dw FROM t JOIN spans ON t.sample_id = spans.sample_id AND spans.r - length(spans.text) <= t.e - 1 AND t.e - 1 < spans.r)"""


OWNED = MATH_SPANS + "," + _tokens(r"[^ \t\n\r]+|[ \t\n\r]+")
WEIGHED = OWNED + """,
w AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 WHEN role = 'assistant' AND span_class IN ('assistant_end', 'role_header') THEN 0.5 WHEN role = 'assistant' AND span_class = 'content' THEN 1.0 ELSE 0.0 END AS weight FROM owned)"""
SIZES = WEIGHED + ", z AS (SELECT sample_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (weight > 0) AS BIGINT) AS selected FROM w GROUP BY 1)"


def _windows(context: int) -> str:
    """Every window's score by a plain join of starts with the tokens in reach."""
    return SIZES + f""",
starts AS (SELECT w.sample_id, w.pos AS start, least(w.pos + 64, n_tokens) AS stop, n_tokens FROM w JOIN z USING (sample_id) WHERE w.pos = 0 OR w.pos + 64 <= n_tokens),
scored AS (SELECT a.sample_id, a.start, a.stop, a.n_tokens, coalesce(sum(b.weight), 0) AS score, count(*) FILTER (b.weight > 0) AS selected, max(b.pos) FILTER (b.weight > 0) AS latest, min(b.pos) FILTER (b.weight > 0) AS earliest
  FROM starts a LEFT JOIN w b ON a.sample_id = b.sample_id AND b.pos > a.start AND b.pos < a.stop GROUP BY ALL),
ranked AS (SELECT *, CASE WHEN selected > 0 THEN earliest - start ELSE 0 END AS context, row_number() OVER (PARTITION BY sample_id ORDER BY (selected > 0 AND earliest - start >= {context}) DESC, score DESC, coalesce(latest, -1) DESC, start) AS k FROM scored),
best AS (SELECT sample_id, n_tokens, start, stop, CAST(selected AS BIGINT) AS selected, CAST(context AS BIGINT) AS context, n_tokens > 64 AND selected > 0 AND context < {context} AS relaxed FROM ranked WHERE k = 1)"""


REASONS = """firsts AS (SELECT conv_id, arg_min(role, turn) AS first_role, bool_or(role NOT IN ('user', 'assistant')) AS other FROM conversations GROUP BY 1),
reasons AS (SELECT conv_id, CASE WHEN first_role <> 'user' THEN 'first message must be user' WHEN other THEN 'only user and assistant roles are supported' END AS reason FROM firsts)"""

CLASSES = _windows(0) + ", " + REASONS + """,
hits AS (SELECT sample_id, count(*) FILTER (role = 'assistant' AND span_class = 'content') AS hit FROM owned GROUP BY 1),
classed AS (SELECT best.*, CASE WHEN reason IS NOT NULL THEN 'adapter_error' WHEN hit = 0 THEN 'fatal' WHEN selected = 0 THEN 'zero_objective' ELSE 'emitted' END AS class FROM best JOIN hits USING (sample_id) JOIN reasons ON conv_id = best.sample_id)"""

ORDER = "o AS (SELECT conv_id AS sample_id, row_number() OVER (ORDER BY sha256('17:' || conv_id), conv_id) - 1 AS position FROM (SELECT DISTINCT conv_id FROM conversations))"
LOGITS = "l AS (SELECT vec_id, label AS target, CAST(vec_id % 3 AS DOUBLE) AS weight, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), loss AS (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[target + 1] AS loss FROM l)"
DAILY = """d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, event_id % 2 AS side, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) / count(*) AS value FROM events GROUP BY 1, 2),
errors AS (SELECT coalesce(a.step, b.step) AS step, abs(a.value - b.value) AS abs_error, abs(a.value - b.value) / greatest(abs(b.value), 1e-12) AS rel_error, a.value IS NOT NULL AND b.value IS NOT NULL AS paired FROM (SELECT * FROM d WHERE side = 0) a FULL JOIN (SELECT * FROM d WHERE side = 1) b ON a.step = b.step)"""
STATE = "s AS (SELECT path, i, CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) * 0.5 - 0.1 AS grad FROM (SELECT vec_id % 4 AS path, vec_id AS i, unnest(embedding) AS v FROM embeddings)), g AS (SELECT sqrt(sum(grad * grad)) AS norm FROM s)"
ALL_MATRICES = "w AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
BLOCKS = WEIGHED + """,
carried AS (SELECT *, coalesce(last_value(message_index IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY pos), 0) AS block FROM w),
b AS (SELECT sample_id, CAST(block AS BIGINT) AS block, min(pos) AS start, max(pos) + 1 AS stop, CAST(sum(weight) AS DOUBLE) AS weight, count(*) FILTER (weight > 0) AS selected FROM carried GROUP BY 1, 2)"""


def _with(body: str, query: str) -> str:
    return f"WITH {body} {query}"


ROLE = "coalesce(role, 'none') AS role"
TEXT = "SELECT sample_id, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS text_sha, sha256('{}' || chr(0) || '1' || chr(0) || text) AS template_hash FROM docs"
OWNER = f"SELECT sample_id, span_class, {ROLE}, CAST(count(*) AS BIGINT) AS token_count, CAST(sum(token_id) AS BIGINT) AS ids FROM owned GROUP BY ALL"
CONFLICT = "SELECT sample_id, CAST(count(*) FILTER (x > 0) AS BIGINT) AS selected, CAST(coalesce(sum(x), 0) AS DOUBLE) AS total_weight, CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM y GROUP BY 1"
BOTH = "role = 'assistant' AND span_class = 'content'"
INDEX = "SELECT sample_id, CAST(position // {p} // {a} AS BIGINT) AS step, CAST(position // {p} % {a} AS BIGINT) AS accumulation, CAST(position // {d} % {n} AS BIGINT) AS process, CAST(position // {e} % {v} AS BIGINT) AS device, CAST(position % {e} AS BIGINT) AS example FROM o"
PADDED = _windows(0) + ", inside AS (SELECT w.sample_id, w.pos - b.start AS place, token_id, CASE WHEN w.pos = b.start THEN 0.0 ELSE weight END AS weight FROM w JOIN best b ON w.sample_id = b.sample_id AND w.pos >= b.start AND w.pos < b.stop)"

SQL = {
    "flagship": _with(WEIGHED, f"SELECT {ROLE}, CAST(count(*) AS BIGINT) AS token_count, CAST(count(*) FILTER (weight > 0) AS BIGINT) AS selected_tokens, CAST(sum(weight) AS DOUBLE) AS total_weight FROM w GROUP BY 1"),
    "adapt_messages_roles": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS message_index, role, CAST(1 AS BIGINT) AS parts, CAST(length(text) AS BIGINT) AS chars FROM conversations",
    "adapt_ultrachat_reject": _with(REASONS, "SELECT coalesce(reason, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS rows FROM reasons GROUP BY 1"),
    "adapter_reason_counts": _with(REASONS, "SELECT reason, CAST(count(*) AS BIGINT) AS rows FROM reasons WHERE reason IS NOT NULL GROUP BY 1"),
    "adapt_prompt_completion": "SELECT conv_id, sha256(arg_min(text, turn) FILTER (role = 'user')) AS user_sha, sha256(arg_min(text, turn) FILTER (role = 'assistant')) AS assistant_sha FROM conversations GROUP BY 1 HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')",
    "adapt_sharegpt_alias": "SELECT role, CAST(count(*) AS BIGINT) AS messages FROM conversations GROUP BY 1",
    "sample_id_fallback": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'repo:train:' || conv_id ELSE 'repo:train:' || sha256('repo' || chr(0) || 'main' || chr(0) || 'default' || chr(0) || 'train' || chr(0) || conv_id) END AS sample_id FROM conversations",
    "render_olmo2_text": _with(OLMO_SPANS, TEXT.format("olmo2_instruct")),
    "render_math_text": _with(MATH_SPANS, TEXT.format("qwen2_5_math")),
    "render_qwen35_text": _with(QWEN_DOCS, TEXT.format("qwen3_5_text")),
    "render_span_inventory": _with(OLMO_SPANS, f"SELECT span_class, {ROLE}, CAST(count(*) AS BIGINT) AS spans, CAST(sum(length(text)) AS BIGINT) AS chars FROM spans GROUP BY ALL"),
    "span_ranges": _with(MATH_SPANS, "SELECT sample_id, span_index, CAST(r - length(text) AS BIGINT) AS left_char, r AS right_char FROM spans"),
    "tokens_char_owner": _with(MATH_SPANS + "," + _tokens(r"[\s\S]"), OWNER),
    "tokens_regex_owner": _with(OWNED, OWNER),
    "alignment_left_vs_right": _with(OWNED, "SELECT o.sample_id, CAST(count(*) AS BIGINT) AS differing FROM owned o JOIN spans p ON o.sample_id = p.sample_id AND p.r - length(p.text) <= o.s AND o.s < p.r WHERE p.span_index <> o.span_index GROUP BY 1"),
    "weights_last_match": _with(WEIGHED + ", y AS (SELECT *, weight AS x FROM w)", CONFLICT.format("role = 'assistant' AND span_class IN ('content', 'assistant_end', 'role_header')")),
    "weights_multiply": _with(OWNED + ", y AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 ELSE dw * CASE WHEN role = 'assistant' THEN 2.0 ELSE 1.0 END * CASE WHEN span_class = 'content' THEN 0.5 ELSE 1.0 END END AS x FROM owned)", CONFLICT.format(BOTH)),
    "weights_conflicts": _with(OWNED + f", y AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 WHEN {BOTH} THEN NULL WHEN span_class = 'content' THEN 0.5 WHEN role = 'assistant' THEN 2.0 ELSE dw END AS x FROM owned)", CONFLICT.format(BOTH)),
    "rule_match_counts": _with(OWNED, "SELECT sample_id, CAST(count(*) AS BIGINT) AS rule_0, CAST(count(*) FILTER (role = 'assistant' AND span_class = 'content') AS BIGINT) AS rule_1, CAST(count(*) FILTER (role = 'assistant' AND span_class IN ('assistant_end', 'role_header')) AS BIGINT) AS rule_2 FROM owned GROUP BY 1"),
    "require_match_failures": "SELECT conv_id AS sample_id FROM conversations GROUP BY 1 HAVING NOT bool_or(role = 'assistant')",
    "zero_objective": _with(SIZES, "SELECT sample_id, n_tokens FROM z WHERE selected = 0"),
    "trunc_right": _with(SIZES, "SELECT sample_id, n_tokens, CAST(0 AS BIGINT) AS start, least(n_tokens, 64) AS stop FROM z"),
    "trunc_left": _with(SIZES, "SELECT sample_id, n_tokens, greatest(n_tokens - 64, 0) AS start, n_tokens AS stop FROM z"),
    "trunc_reject": _with(SIZES, "SELECT sample_id, n_tokens, CAST(0 AS BIGINT) AS start, CASE WHEN n_tokens <= 64 THEN n_tokens ELSE 0 END AS stop FROM z"),
    "trunc_loss_aware": _with(_windows(0), "SELECT * FROM best"),
    "trunc_loss_aware_ctx": _with(_windows(8), "SELECT * FROM best"),
    "message_blocks": _with(BLOCKS, "SELECT * FROM b"),
    "trunc_semantic": _with(BLOCKS, """, c AS (SELECT i.sample_id, i.start, j.stop, i.block AS first_block, j.block AS last_block, coalesce(sum(k.weight), 0) AS score, coalesce(max(k.pos) FILTER (k.weight > 0), -1) AS latest, min(k.pos) FILTER (k.weight > 0) AS earliest
  FROM b i JOIN b j ON i.sample_id = j.sample_id AND i.block <= j.block AND j.stop - i.start <= 64 LEFT JOIN w k ON k.sample_id = i.sample_id AND k.pos > i.start AND k.pos < j.stop GROUP BY i.sample_id, i.start, j.stop, i.block, j.block),
  total AS (SELECT sample_id, sum(weight) AS weight FROM w GROUP BY 1),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, latest DESC, coalesce(earliest - start, 0) DESC, stop - start DESC, start) AS k FROM c JOIN total USING (sample_id) WHERE weight = 0 OR score > 0)
  SELECT total.sample_id, start, stop, first_block, last_block, CAST(score AS DOUBLE) AS score FROM total LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (sample_id)"""),
    "classify_rows": _with(CLASSES, "SELECT sample_id, class FROM classed"),
    "stream_counters": _with(CLASSES, "SELECT CAST(count(*) AS BIGINT) AS rows_seen, " + ", ".join(f"CAST(count(*) FILTER (class = '{c}') AS BIGINT) AS {c}" for c in ("adapter_error", "fatal", "semantic_rejection", "length_rejection", "zero_objective", "emitted")) + ", CAST(count(*) FILTER (n_tokens > 64 AND class IN ('zero_objective', 'emitted')) AS BIGINT) AS truncated_samples, CAST(coalesce(sum(n_tokens - (stop - start)) FILTER (n_tokens > 64 AND class IN ('zero_objective', 'emitted')), 0) AS BIGINT) AS tokens_dropped FROM classed"),
    "shuffle_rank_split": _with(ORDER, "SELECT sample_id, position, position % 4 AS rank FROM o"),
    "microbatch_index": _with(ORDER, INDEX.format(p=8, a=2, d=4, n=2, e=2, v=2)),
    "tape_replay_slices": _with(ORDER + ", x AS (" + INDEX.format(p=16, a=1, d=8, n=2, e=4, v=2) + ")", "SELECT step, process, CAST(count(*) AS BIGINT) AS rows, CAST(sum(sample_id) AS BIGINT) AS ids FROM x GROUP BY ALL"),
    "padded_batches": _with(PADDED, "SELECT sample_id, CAST(64 AS BIGINT) AS length, CAST(sum(token_id * (place + 1)) AS BIGINT) AS ids, CAST(count(*) AS BIGINT) AS real, CAST(sum(weight) AS DOUBLE) AS weight FROM inside GROUP BY 1"),
    "tape_validation": "SELECT DISTINCT conv_id AS item, 'a weight is negative or no number' AS fault FROM conversations WHERE conv_id % 4 = 1",
    "resume_cursor": _with(ORDER, "SELECT sample_id, position FROM o WHERE position % 4 = 1 AND position >= 13"),
    "epoch_rollover": "WITH o AS (SELECT epoch, conv_id AS sample_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256((17 + epoch) || ':' || conv_id), conv_id) - 1 AS position, count(*) OVER (PARTITION BY epoch) AS n FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT range AS epoch FROM range(4))), r AS (SELECT *, row_number() OVER (ORDER BY epoch, position) AS k, (n - 1 + 3) // 4 AS per FROM o WHERE position % 4 = 1) SELECT epoch, sample_id, position FROM r WHERE k > 3 AND k <= 3 + per * 5 // 2",
    "explain_all_tokens": _with(WEIGHED, f"SELECT sample_id, pos, token, CAST(s AS BIGINT) AS start_char, e AS end_char, span_class, {ROLE}, CAST(weight AS DOUBLE) AS weight FROM w"),
    "loss_statistics": _with(LOGITS, "SELECT round(sum(loss * weight), 3) AS numerator, sum(weight) AS denominator, sum(CASE WHEN list_position(x, list_max(x)) - 1 = target THEN weight ELSE 0 END) AS correct_weight, CAST(count(*) FILTER (weight > 0) AS BIGINT) AS token_count, round(sum(loss * weight) / greatest(sum(weight), 1e-12), 5) AS loss FROM loss"),
    "loss_ratio_of_sums": _with(LOGITS + ", p AS (SELECT target, sum(loss * weight) AS n, sum(weight) AS d FROM loss GROUP BY 1)", "SELECT round(sum(n) / sum(d), 5) AS ratio_of_sums, round(avg(n / d), 5) AS mean_of_ratios FROM p"),
    "trajectory_compare": _with(DAILY, "SELECT step, paired, round(abs_error, 4) AS abs_error, round(rel_error, 4) AS rel_error FROM errors"),
    "trajectory_stability": _with(DAILY + ", k AS (SELECT *, row_number() OVER (ORDER BY step) AS rank, count(*) OVER () AS n FROM errors WHERE paired)", "SELECT CAST(count(*) AS BIGINT) AS steps, round(avg(rel_error) FILTER (rank <= n // 2), 4) AS early_mean, round(avg(rel_error) FILTER (rank > n // 2), 4) AS late_mean, round(regr_slope(rel_error, step), 5) AS slope FROM k"),
    "grad_norm_clip": _with(STATE, "SELECT path, round(sqrt(sum((grad * least(1.0, 1.0 / (norm + 1e-6))) ** 2)), 6) AS clipped, round(any_value(norm), 4) AS norm FROM s, g GROUP BY path"),
    "adamw_step": _with(STATE + ", c AS (SELECT path, value, grad * least(1.0, 1.0 / (norm + 1e-6)) AS grad FROM s, g), n AS (SELECT path, value, 0.9 * value * 0.01 + 0.1 * grad AS m, 0.95 * value * value * 0.01 + 0.05 * grad * grad AS v FROM c)", "SELECT path, round(sum(value - 0.1 * ((m / (1 - 0.9 ** 3)) / (sqrt(v / (1 - 0.95 ** 3)) + 1e-8) + CASE WHEN path = 0 THEN 0 ELSE 0.1 * value END)), 4) AS value, round(sum(m), 4) AS m, round(sum(v), 4) AS v FROM n GROUP BY 1"),
    "lora_merge_all": _with(ALL_MATRICES + ", d AS (SELECT a.i, b.j, sum(a.value * b.value) AS delta FROM w a JOIN w b ON a.j = b.i WHERE a.j < 4 AND b.i < 4 GROUP BY ALL)", "SELECT w.i, w.j, round(w.value + coalesce(d.delta, 0) * 2.0, 6) AS value FROM w LEFT JOIN d ON w.i = d.i AND w.j = d.j"),
    "lora_param_count_all": _with(ALL_MATRICES, "SELECT 'w' AS path, CAST(count(*) FILTER (j < 4) + count(*) FILTER (i < 4) AS BIGINT) AS parameters FROM w"),
    "metrics_rollup": _with(WEIGHED, "SELECT role, span_class, CAST(count(*) AS BIGINT) AS token_count, CAST(sum(weight) AS DOUBLE) AS total_weight, CAST(grouping(role, span_class) AS BIGINT) AS level FROM w GROUP BY ROLLUP (role, span_class)"),
}
