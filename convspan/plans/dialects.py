"""Queries on typed content blocks, on what renderers refuse and on generation prompts, each beside its DuckDB twin.

Typed rows are made from the conversations by a rule that both engines know; samples are damaged by their number modulo 9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.operators import adapters, render, typed_blocks
from convspan.plans.oracle import MATH_SPANS, MESSAGES, OLMO_SPANS, QWEN_DOCS
from convspan.sources import tables


def _typed_rows(spark, sf_dir) -> DataFrame:
    """sample_id and the row as JSON: assistants think, speak and call; users have blocks or a string; every third sample has tools."""
    m = tables.message_table(tables.table(spark, sf_dir, "conversations"))
    kind, i = F.col("sample_id") % 9, F.col("message_index")
    block = lambda **f: F.to_json(F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in f.items()]))
    name = F.when((kind == 3) & (i == 1), "").otherwise("find")
    call = F.concat(F.lit('{"type":"tool_use","id":"c'), i.cast("string"), F.lit('","name":"'), name, F.lit('","input":{"n":'), i.cast("string"), F.lit("}}"))
    speech = F.when((kind == 4) & (i == 1), F.lit('{"type":"text"}')).when((kind == 5) & (i == 1), F.lit('{"type":"audio","text":"x"}')).otherwise(block(type="output_text", text=F.col("text")))
    blocks = F.concat(F.lit("["), F.concat_ws(",", block(type="thinking", thinking="well"), speech, call), F.lit("]"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    content = F.when(F.col("role") == "assistant", blocks).when(i % 2 == 0, F.concat(F.lit("["), block(type="input_text", text=F.col("text")), F.lit("]"))).otherwise(quoted(F.col("text")))
    more = F.when((kind == 6) & (F.col("role") == "user"), F.lit(',"reasoning_content":"hm"')).when((kind == 7) & (i == 0), F.lit(',"name":""')).otherwise("")
    shown = F.concat(F.lit('{"role":"'), F.when((kind == 8) & (i == 0), "narrator").otherwise(F.col("role")), F.lit('","content":'), content, more, F.lit("}"))
    rows = m.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_index", shown.alias("shown")))), lambda x: x["shown"]), ",").alias("all"))
    tools = F.when(F.col("sample_id") % 3 == 0, F.lit(',"tools":[{"function":{"name":"find","parameters":{"type":"object"}}}]')).otherwise("")
    return rows.select("sample_id", F.concat(F.lit('{"messages":['), F.col("all"), F.lit("]"), tools, F.lit("}")).alias("row"))


def _adapted(spark, sf_dir) -> DataFrame:
    rows = _typed_rows(spark, sf_dir).select("sample_id", F.from_json("row", typed_blocks.ROW).alias("r")).select("sample_id", "r.*")
    return typed_blocks.typed_messages_adapter(rows)


def adapt_typed_blocks(spark, sf_dir):
    """The parts of all accepted samples."""
    m = _adapted(spark, sf_dir).where("reason is null").select("sample_id", F.posexplode("messages").alias("message_index", "m"))
    p = m.select("sample_id", F.col("message_index").cast("long"), F.col("m.role").alias("role"), F.posexplode("m.parts").alias("part_index", "p"))
    return p.select("sample_id", "message_index", "role", F.col("part_index").cast("long"), "p.kind", F.sha2("p.value", 256).alias("value_sha"), "p.call_id", "p.tool_name")


def typed_block_rejects(spark, sf_dir):
    return adapters.reason_counts(_adapted(spark, sf_dir))


def renderer_rejects(spark, sf_dir):
    """Why templates without tools refuse samples."""
    found = render.text_template_errors(_adapted(spark, sf_dir).where("reason is null"))
    return found.groupBy("error").agg(F.count(F.lit(1)).alias("samples"))


TYPED = MESSAGES + """,
k AS (SELECT *, sample_id % 9 AS kind FROM m),
reasons AS (SELECT sample_id, CASE WHEN any_value(kind) = 8 THEN 'unknown message role' WHEN any_value(kind) = 7 THEN 'an identifier must be a non-empty string' WHEN any_value(kind) = 6 AND bool_or(role = 'user') THEN 'reasoning belongs to an assistant and is a string'
    WHEN any_value(kind) = 3 AND bool_or(role = 'assistant' AND message_index = 1) THEN 'a call needs a name' WHEN any_value(kind) = 4 AND bool_or(role = 'assistant' AND message_index = 1) THEN 'a text block needs a string'
    WHEN any_value(kind) = 5 AND bool_or(role = 'assistant' AND message_index = 1) THEN 'a block has an unsupported type' END AS reason FROM k GROUP BY 1),
ok AS (SELECT k.* FROM k JOIN reasons USING (sample_id) WHERE reason IS NULL),
parts AS (SELECT sample_id, message_index, role, 0 AS part_index, CASE WHEN role = 'assistant' THEN 'reasoning' ELSE 'text' END AS kind, CASE WHEN role = 'assistant' THEN 'well' ELSE text END AS value, NULL AS call_id, NULL AS tool_name FROM ok
  UNION ALL SELECT sample_id, message_index, role, 1, 'text', text, NULL, NULL FROM ok WHERE role = 'assistant'
  UNION ALL SELECT sample_id, message_index, role, 2, 'tool_call', '{"n":' || message_index || '}', 'c' || message_index, 'find' FROM ok WHERE role = 'assistant')"""


def _prompted(name: str, **more):
    def run(spark, sf_dir):
        m = tables.message_table(tables.table(spark, sf_dir, "conversations"))
        text = render.documents(render.get_renderer(name)(m, generation_prompt=True, **more))
        return text.select("sample_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha"))

    return run


def _prompt_sql(body: str, suffix: str) -> str:
    return f"WITH {body} SELECT sample_id, CAST(length(text || {suffix}) AS BIGINT) AS chars, sha256(text || {suffix}) AS text_sha FROM docs"


def sample_sources(spark, sf_dir):
    """Where each sample comes from, ids of odd conversations being unknown."""
    c = tables.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    given = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id"))
    return c.select("conv_id", adapters.source("repo", "main", "default", "train", F.col("conv_id"), given).alias("s")).select("conv_id", "s.*")


def queries() -> dict:
    return {f.__name__: f for f in (adapt_typed_blocks, typed_block_rejects, renderer_rejects, sample_sources)} | {
        "generation_prompt_olmo2": _prompted("olmo2_instruct"), "generation_prompt_math": _prompted("qwen2_5_math"), "generation_prompt_qwen35": _prompted("qwen3_5_text"), "generation_prompt_thinking": _prompted("qwen3_5_text", thinking=True),
    }


SQL = {
    "sample_sources": "SELECT DISTINCT conv_id, 'repo' AS repo, 'main' AS revision, 'default' AS config, 'train' AS split, conv_id AS row_index, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS row_id FROM conversations",
    "adapt_typed_blocks": f"WITH {TYPED} SELECT sample_id, message_index, role, CAST(part_index AS BIGINT) AS part_index, kind, sha256(value) AS value_sha, call_id, tool_name FROM parts",
    "typed_block_rejects": f"WITH {TYPED} SELECT reason, CAST(count(*) AS BIGINT) AS rows FROM reasons WHERE reason IS NOT NULL GROUP BY 1",
    "renderer_rejects": f"WITH {TYPED}, e AS (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'the template has no tool definitions' WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'the template has no such role' WHEN bool_or(role = 'assistant') THEN 'the template shows text only' END AS error FROM ok GROUP BY 1) SELECT error, CAST(count(*) AS BIGINT) AS samples FROM e WHERE error IS NOT NULL GROUP BY 1",
    "generation_prompt_olmo2": _prompt_sql(OLMO_SPANS, "'<|assistant|>' || chr(10)"),
    "generation_prompt_math": _prompt_sql(MATH_SPANS, "'<|im_start|>assistant' || chr(10)"),
    "generation_prompt_qwen35": _prompt_sql(QWEN_DOCS, "'<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"),
    "generation_prompt_thinking": _prompt_sql(QWEN_DOCS, "'<|im_start|>assistant' || chr(10) || '<think>' || chr(10)"),
}
