"""Queries on recipes, templates with tools, schedules and tapes over the given tables, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.functions import json_domain
from convspan.operators import batch, render, render_tools, stats, tool_units
from convspan.plans.exchanges import AUDIT, TOOLS, tool_messages
from convspan.plans.oracle import ORDER, PADDED
from convspan.sources import tables, training_recipe
from convspan.sources.stage import staged

DESCRIPTION, PARAMETERS = "Find things", '{"type": "object"}'


def tool_units_fixture(spark, sf_dir):
    """Units of the exchanges of all conversations, and why samples have none."""
    found = tool_units.tool_units(staged(tool_messages(spark, sf_dir)))
    return found.select("sample_id", *[F.col(c).cast("long") for c in ("unit", "first_message", "last_message")], "has_tool_call", "reason")


def _tool_samples(spark, sf_dir) -> DataFrame:
    """The exchanges of all conversations in the message model; every second sample has a tool."""
    m = tool_messages(spark, sf_dir)
    none = F.lit(None).cast("string")
    part = lambda kind, value, call, name: F.struct(kind.alias("kind"), value.alias("value"), call.alias("call_id"), name.alias("tool_name"))
    own = part(F.when(F.col("role") == "tool", "tool_result").otherwise("text"), F.col("text"), F.when(F.col("role") == "tool", F.get("result_ids", F.lit(0))), none)
    arguments = F.concat(F.lit('{"q": "'), F.col("sample_id").cast("string"), F.lit('", "n": '), F.col("message_index").cast("string"), F.lit("}"))
    parts = F.concat(F.array(own), F.transform("call_ids", lambda c: part(F.lit("tool_call"), arguments, c, F.lit("lookup"))))
    rows = m.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("message_index", "role", parts.alias("parts")))).alias("x"))
    tool = F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit("lookup").alias("name"), F.lit(DESCRIPTION).alias("description"), F.lit(PARAMETERS).alias("parameters")).alias("function")))
    return rows.select("sample_id", F.transform("x", lambda r: F.struct(r["role"].alias("role"), r["parts"].alias("parts"))).alias("messages"), F.when(F.col("sample_id") % 2 == 0, tool).alias("tools"))


def render_qwen35_tools(spark, sf_dir):
    """The text of every sample that the template with tools shows."""
    rows = staged(_tool_samples(spark, sf_dir))
    shown = rows.join(render_tools.errors(rows), "sample_id", "left_anti")
    text = render.documents(render_tools.qwen3_5_with_tools(shown))
    return text.select("sample_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha"))


def recipe_identity(spark, sf_dir):
    """Identities of a recipe for each conversation, or what is wrong with it; some spell out what is the default."""
    c = tables.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    kind = F.col("conv_id") % 10
    more = F.when(kind == 7, ',"speed":1').when(kind == 8, ',"split":"test"').otherwise("")
    spelled = F.when(F.col("conv_id") % 2 == 0, '"epsilon":0.00000001,"warmup_steps":0,').otherwise("")
    length = F.when(kind == 9, F.lit("1")).otherwise((F.col("conv_id") + 2).cast("string"))
    text = F.concat(
        F.lit('{"schema_version":1,"run":{"output_dir":"out"},"model":{"architecture":"olmo2","repo_id":"a/b","revision":"1"},"data":{"repo_id":"c/d","split":"train","adapter":"messages","revision":"'), F.col("conv_id").cast("string"), F.lit('"'), more,
        F.lit('},"objective":{"rules":[{"weight":1,"select":{"role":"assistant"},"require_match":true,"name":"r"}]},"training":{'), spelled, F.lit('"steps":10,"peak_learning_rate":1e-5,"max_length":'), length, F.lit("}}"),
    )
    return c.select("conv_id", training_recipe.resolved(text).alias("r")).select("conv_id", "r.identity", "r.error")


def cosine_schedule(spark, sf_dir):
    """The learning rate at each event, the events being the steps of a run."""
    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("step"))
    total = (e.agg(F.max("step").alias("m")).first().m or 0) + 2
    return e.select("step", F.round(stats.cosine_rate(F.col("step"), 1.0, total, total // 10), 9).alias("rate"))


def synthetic_batches(spark, sf_dir):
    """Made-up rows for the items that the conversations name."""
    items = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    t = batch.synthetic(spark, items, 32, 50_000, 23)
    ids = F.aggregate(F.transform("input_ids", lambda x, p: x.cast("long") * (p + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return t.select("item", ids.alias("ids"), F.aggregate("loss_weights", F.lit(0.0), lambda s, x: s + x).alias("weight"))


def json_values(spark, sf_dir):
    """Rows of JSON text with keys in an order of their own and numbers in many spellings, one in three broken: as they stand, or where they break."""
    m = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("sha"))
    kind = (F.col("conv_id") + F.col("turn")) % 15
    more = F.when(kind == 1, ', "z": {"a": 1}').when(kind == 2, ', "n": NaN').otherwise("")
    last = F.when(kind == 3, " ]").otherwise("")
    item = F.when(kind == 4, "-Infinity").when(kind == 0, "1e400").otherwise("1.50")
    text = F.concat(F.lit(' { "z" : "'), "sha", F.lit('" , "a" : [ '), F.col("turn").cast("string"), F.lit(".0e+1 , { } , "), item, F.lit(" ]"), more, F.lit(" }"), last)
    return m.select("conv_id", F.col("turn").cast("long"), json_domain.checked(text).alias("c")).select("conv_id", "turn", "c.value", "c.fault")


def _tape(spark, sf_dir) -> DataFrame:
    """All padded samples as a tape of 16 rows a step, in the first epoch's order."""
    from convspan.plans.catalogue import _order, _padded

    rows = batch.placed(_padded(spark, sf_dir), _order(spark, sf_dir))
    return staged(rows.select(F.floor(F.col("position") / 16).cast("int").alias("step"), F.col("position").alias("item"), "input_ids", "attention_mask", "loss_weights"))


def tape_audit(spark, sf_dir):
    """What a tape lacks, has beyond, twice or changed, after damage by item."""
    t = _tape(spark, sf_dir)
    kind = F.col("item") % 16
    damaged = t.where(kind != 1).withColumn("item", F.when(kind == 2, F.col("item") + 1_000_000_000_000).otherwise(F.col("item")))
    damaged = damaged.withColumn("input_ids", F.when(F.col("item") % 16 == 3, F.transform("input_ids", lambda x: x + 1)).otherwise(F.col("input_ids")))
    return batch.audit(t, damaged.unionByName(damaged.where(F.col("item") % 16 == 4))).groupBy("fault").agg(F.count(F.lit(1)).alias("rows"), F.sum("item").alias("items"))


def tape_identities(spark, sf_dir):
    """How many identities the steps of a tape, of its copy with other partitions and of a changed copy have between them."""
    t = _tape(spark, sf_dir)
    changed = t.withColumn("loss_weights", F.when((F.col("step") % 2 == 1) & (F.col("item") % 16 == 0), F.transform("loss_weights", lambda w: w + F.lit(1).cast("float"))).otherwise(F.col("loss_weights")))
    every = batch.manifest(t).unionByName(batch.manifest(t.repartition("input_ids"))).unionByName(batch.manifest(changed))
    return every.groupBy("step").agg(F.sum("rows").alias("rows"), F.count_distinct("identity").alias("identities")).select(F.col("step").cast("long"), "rows", "identities")


def queries() -> dict:
    return {f.__name__: f for f in (tool_units_fixture, render_qwen35_tools, recipe_identity, cosine_schedule, synthetic_batches, json_values, tape_audit, tape_identities)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


DEFINITION = f'{{"type": "function", "function": {{"name": "lookup", "description": "{DESCRIPTION}", "parameters": {PARAMETERS}}}}}'
HEAD = _text("<|im_start|>system\n" + render_tools.TOOL_PREAMBLE + "\n" + DEFINITION + render_tools.TOOL_INSTRUCTIONS)
TURN, END = "'<|im_start|>{}' || chr(10)", "'<|im_end|>' || chr(10)"
CALL = "'<tool_call>' || chr(10) || '<function=lookup>' || chr(10) || '<parameter=q>' || chr(10) || sample_id || chr(10) || '</parameter>' || chr(10) || '<parameter=n>' || chr(10) || i || chr(10) || '</parameter>' || chr(10) || '</function>' || chr(10) || '</tool_call>'"
SHOWN = TOOLS + f""",
turns AS (SELECT *, sample_id % 2 = 0 AS tooled, max(i) FILTER (role = 'user') OVER (PARTITION BY sample_id) AS q, bool_or(role = 'system' AND i > 0) OVER (PARTITION BY sample_id) AS late, lag(role) OVER w AS before, lead(role) OVER w AS after FROM tm WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
chunks AS (SELECT *, CASE WHEN i = 0 AND tooled THEN {HEAD} || CASE WHEN role <> 'system' THEN {END} ELSE '' END ELSE '' END || CASE role
    WHEN 'system' THEN CASE WHEN tooled THEN CASE WHEN text <> '' THEN chr(10) || chr(10) ELSE '' END ELSE {TURN.format('system')} END || text || {END}
    WHEN 'user' THEN {TURN.format('user')} || text || {END}
    WHEN 'assistant' THEN {TURN.format('assistant')} || CASE WHEN i > q THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || CASE WHEN len(calls) > 0 THEN CASE WHEN text <> '' THEN chr(10) || chr(10) ELSE '' END || array_to_string(list_transform(calls, lambda c: {CALL}), chr(10)) ELSE '' END || {END}
    WHEN 'tool' THEN CASE WHEN coalesce(before, '') <> 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || CASE WHEN coalesce(after, '') <> 'tool' THEN {END} ELSE '' END END AS shown FROM turns WHERE q IS NOT NULL AND NOT late),
d AS (SELECT sample_id, string_agg(shown, '' ORDER BY i) AS text FROM chunks GROUP BY 1)"""
RECIPE = """'{"data":{"adapter":"messages","config":"default","loading_mode":"streaming","renderer":null,"repo_id":"c/d","revision":"' || conv_id || '","shuffle_buffer_size":10000,"shuffle_seed":17,"split":"train"},"model":{"architecture":"olmo2","dtype":"bfloat16","local_path":null,"repo_id":"a/b","revision":"1"},"objective":{"conflict_mode":"last_match","rules":[{"name":"r","require_match":true,"select":{"role":"assistant"},"weight":1.0}]},"run":{"output_dir":"out","seed":17},"schema_version":1,"training":{"beta1":0.9,"beta2":0.95,"checkpoint_every":0,"epsilon":1e-08,"gradient_accumulation_steps":1,"log_every":1,"max_grad_norm":1.0,"max_length":' || (conv_id + 2) || ',"minimum_learning_rate_ratio":0.1,"peak_learning_rate":1e-05,"per_device_batch_size":1,"remat":true,"steps":10,"truncation":"right","truncation_min_context_tokens":0,"warmup_steps":0,"weight_decay":0.1}}'"""
ITEMS = f"{PADDED}, {ORDER}, p AS (SELECT DISTINCT position // 16 AS step, position AS item FROM inside JOIN o USING (sample_id))"
SQL = {
    "tool_units_fixture": f"WITH {AUDIT}, g AS (SELECT sample_id, unit, min(i) AS first_message, max(i) AS last_message, bool_or(tool_exchange) AS has_tool_call FROM units GROUP BY 1, 2) SELECT *, NULL AS reason FROM g UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, reason FROM bad",
    "render_qwen35_tools": f"WITH {SHOWN} SELECT sample_id, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS text_sha FROM d",
    "recipe_identity": f"SELECT conv_id, CASE WHEN conv_id % 10 < 7 THEN sha256('convspan-run' || chr(0) || {RECIPE}) END AS identity, CASE conv_id % 10 WHEN 7 THEN 'data has unknown keys [''speed'']' WHEN 8 THEN 'a key stands twice among [''repo_id'', ''split'', ''adapter'', ''revision'', ''split'']' WHEN 9 THEN 'training.max_length must be 2 or more' END AS error FROM (SELECT DISTINCT conv_id FROM conversations)",
    "cosine_schedule": "WITH t AS (SELECT coalesce(max(event_id), 0) + 2 AS n FROM events) SELECT CAST(event_id AS BIGINT) AS step, round(CASE WHEN event_id < n // 10 THEN CAST(event_id AS DOUBLE) / greatest(n // 10, 1) ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((event_id - n // 10) / CAST(n - n // 10 AS DOUBLE), 0), 1))) END, 9) AS rate FROM events, t",
    "synthetic_batches": "WITH g AS (SELECT item, p.range AS p, CAST('0x' || substr(sha256('23:' || item || ':' || p.range), 1, 8) AS BIGINT) % 50000 AS id FROM (SELECT DISTINCT conv_id AS item FROM conversations), range(32) p) SELECT item, CAST(sum(id * (p + 1)) AS BIGINT) AS ids, 16.0 AS weight FROM g GROUP BY 1",
    "json_values": "WITH k AS (SELECT conv_id, turn, sha256(text) AS sha, (conv_id + turn) % 15 AS kind FROM conversations) SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN kind > 4 THEN '{\"z\":\"' || sha || '\",\"a\":[' || turn || '.0e+1,{},1.50]}' END AS value, CASE kind WHEN 0 THEN '$.a[2]: not a finite number' WHEN 1 THEN '$.z: a key stands twice' WHEN 2 THEN '$.n: not a finite number' WHEN 3 THEN '$: text after the value' WHEN 4 THEN '$.a[2]: not a finite number' END AS fault FROM k",
    "tape_audit": f"WITH {ITEMS}, f AS (SELECT item, 'missing' AS fault FROM p WHERE item % 16 IN (1, 2) UNION ALL SELECT item + 1000000000000, 'unexpected' FROM p WHERE item % 16 = 2 UNION ALL SELECT item, 'changed' FROM p WHERE item % 16 = 3 UNION ALL SELECT item, 'twice' FROM p WHERE item % 16 = 4) SELECT fault, CAST(count(*) AS BIGINT) AS rows, CAST(sum(item) AS BIGINT) AS items FROM f GROUP BY 1",
    "tape_identities": f"WITH {ITEMS} SELECT step, CAST(count(*) * 3 AS BIGINT) AS rows, CAST(CASE WHEN step % 2 = 1 THEN 2 ELSE 1 END AS BIGINT) AS identities FROM p GROUP BY 1",
}
