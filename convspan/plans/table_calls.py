"""Queries that call the table functions by SQL, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspan.functions import table_functions
from convspan.plans.encoding import _merged, tokenizer_file
from convspan.plans.oracle import MESSAGES
from convspan.sources import tables


def _view(frame, name: str) -> str:
    frame.createOrReplaceTempView(f"convspan_{name}")
    return f"convspan_{name}"


def adapt_by_sql(spark, sf_dir):
    """The first question and answer of every conversation by an adapter of a user's, or why there is none."""
    from convspan.plans.catalogue import _rows

    table_functions.register(spark)
    view = _view(_rows(spark, sf_dir).select("conv_id", "messages"), "raw")
    return spark.sql(f"SELECT conv_id, CAST(message_index AS BIGINT) AS message_index, role, sha2(message, 256) AS text_sha, reason FROM adapt_rows(TABLE({view}), adapter => 'convspan.functions.table_functions:first_exchange')")


def render_by_sql(spark, sf_dir):
    """Texts of all conversations by a renderer of a user's."""
    table_functions.register(spark)
    view = _view(tables.message_table(tables.table(spark, sf_dir, "conversations")).select("sample_id", "message_index", "role", "text"), "messages")
    spans = spark.sql(f"SELECT * FROM render_rows(TABLE({view}) PARTITION BY sample_id ORDER BY message_index, renderer => 'convspan.functions.table_functions:transcript')")
    parts = F.array_sort(F.collect_list(F.struct("span_index", "text")))
    return spans.groupBy("sample_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), ""), 256).alias("text_sha"), F.count(F.lit(1)).alias("spans"), F.sum("default_weight").alias("weight"))


def encode_by_sql(spark, sf_dir):
    """Tokens of every message by a tokenizer file that the call names."""
    table_functions.register(spark)
    view = _view(tables.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text"), "texts")
    return spark.sql(f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, count(*) AS n_tokens, sum(CAST(token_id AS BIGINT) * (pos + 1)) AS ids, sum(end - start) AS chars FROM encode_texts(TABLE({view}), encoder => '{tokenizer_file()}') GROUP BY ALL")


def queries() -> dict:
    found = {f.__name__: f for f in (adapt_by_sql, render_by_sql)}
    return found | ({"encode_by_sql": encode_by_sql} if tokenizer_file() else {})


SQL = {
    "adapt_by_sql": f"WITH {MESSAGES}, p AS (SELECT *, lead(role) OVER w AS after, lead(text) OVER w AS answer FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY message_index)), f AS (SELECT sample_id, arg_min(text, message_index) AS q, arg_min(answer, message_index) AS a FROM p WHERE role = 'user' AND after = 'assistant' GROUP BY 1), "
                    "c AS (SELECT DISTINCT sample_id FROM m) SELECT sample_id AS conv_id, CAST(0 AS BIGINT) AS message_index, 'user' AS role, sha256(q) AS text_sha, NULL AS reason FROM f UNION ALL SELECT sample_id, 1, 'assistant', sha256(a), NULL FROM f UNION ALL SELECT sample_id, NULL, NULL, NULL, 'no question with an answer' FROM c WHERE sample_id NOT IN (SELECT sample_id FROM f)",
    "render_by_sql": f"WITH {MESSAGES} SELECT sample_id, sha256(string_agg(role || ': ' || text || chr(10), '' ORDER BY message_index)) AS text_sha, CAST(count(*) * 2 + count(*) FILTER (text <> '') AS BIGINT) AS spans, CAST(count(*) FILTER (role = 'assistant' AND text <> '') AS DOUBLE) AS weight FROM m GROUP BY 1",
}
if tokenizer_file():
    SQL["encode_by_sql"] = f"WITH RECURSIVE {_merged('SELECT conv_id || chr(58) || turn AS key, text FROM conversations')}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k, n, t) AS p FROM toks) SELECT CAST(split_part(key, ':', 1) AS BIGINT) AS conv_id, CAST(split_part(key, ':', 2) AS BIGINT) AS turn, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(id * p) AS BIGINT) AS ids, CAST(sum(e - s) AS BIGINT) AS chars FROM o GROUP BY 1, 2"
