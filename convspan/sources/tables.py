"""Readers: message tables, raw chat rows with an explicit schema per dialect, and JSON-lines event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.operators import typed_blocks

#: One schema per dialect; JSON-valued fields stay strings. Nothing is inferred.
DIALECTS = {
    "messages": f"id string, prompt_id string, {typed_blocks.ROW}",
    "ultrachat_200k": "prompt string, prompt_id string, messages array<struct<role:string,content:variant>>",
    "prompt_completion": "id string, prompt string, completion string",
    "sharegpt": "id string, conversations array<struct<from:string,value:variant,role:string,content:variant>>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, path: str, dialect: str, one_row: bool = False) -> DataFrame:
    """JSON-lines rows of a dialect, or files of one row each, whose JSON may stretch over lines."""
    if dialect not in DIALECTS:
        raise KeyError(f"unknown dialect {dialect!r}; known: {sorted(DIALECTS)}")
    return spark.read.schema(DIALECTS[dialect]).json(path, multiLine=one_row)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest, a JSON object that may stretch over lines; keys that the schema lacks are passed over, text that is no JSON is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def events(spark: SparkSession, path: str) -> DataFrame:
    """event, line of a log's JSON lines; lines that are no JSON object with a string event are skipped."""
    lines = spark.read.text(path).where(F.is_valid_utf8("value"))
    event = F.try_variant_get(F.try_parse_json("value"), "$.event", "variant")
    return lines.where(F.schema_of_variant(event) == "STRING").select(F.try_variant_get(event, "$", "string").alias("event"), F.col("value").alias("line"))


#: Bytes of text that a task has: one row for each character are some hundred times as many bytes.
TASK_BYTES = 1_000_000


def dealt(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows (sample_id, text, ...) dealt by sample, about TASK_BYTES of text to a task, so there are more tasks for more text.

    What is done by sample afterwards stays in these tasks; messages, small as they are, would be put together in a few tasks before
    their tokens, many times as large, are made. Staged rows are not known to be dealt any more.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "sample_id")


def message_table(conversations: DataFrame) -> DataFrame:
    """sample_id, message_index, role, text, n_messages of a table (conv_id, turn, role, text), numbered from 0 without gaps; dealt by sample."""
    from pyspark.sql import Window

    messages = dealt(conversations.select(F.col("conv_id").alias("sample_id"), "turn", "role", "text"))
    order = Window.partitionBy("sample_id").orderBy("turn")
    numbered = messages.select("sample_id", (F.row_number().over(order) - 1).alias("message_index"), "role", "text")
    return numbered.withColumn("n_messages", F.count(F.lit(1)).over(Window.partitionBy("sample_id")))


def batches_schema() -> T.StructType:
    return T._parse_datatype_string("step int, item int, input_ids array<int>, attention_mask array<boolean>, loss_weights array<float>")
