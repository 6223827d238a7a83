"""Raw rows to one typed message model: (sample_id, messages, tools, reason), reason null for accepted rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspan.operators import typed_blocks

def sample_id(repo: str, revision: str, config: str, split: str, row_index: Column, *ids: Column) -> Column:
    """repo:split:id of the first non-empty id, else repo:split: and the hash of where the row stands.

    row_index is a stable number of the row in its source, so an id does not depend on ranks or shuffles.
    """
    given = F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in ids]) if ids else F.lit(None).cast("string")
    place = F.sha2(F.concat_ws("\0", F.lit(repo), F.lit(revision), F.lit(config), F.lit(split), row_index.cast("string")), 256)
    return F.concat(F.lit(f"{repo}:{split}:"), F.coalesce(given, place))


def source(repo: str, revision: str, config: str, split: str, row_index: Column, *ids: Column) -> Column:
    """Where a row comes from: a struct of repo, revision, config, split, row_index and row_id, the first of ids that is there."""
    row_id = F.coalesce(*[i.cast("string") for i in ids]) if ids else F.lit(None).cast("string")
    given = {"repo": repo, "revision": revision, "config": config, "split": split}
    return F.struct(*[F.lit(v).alias(k) for k, v in given.items()], row_index.cast("long").alias("row_index"), row_id.alias("row_id"))


def messages_adapter(rows: DataFrame) -> DataFrame:
    """Rows with messages, and tools if they have them, in the message model; see typed_blocks for what may stand where."""
    return typed_blocks.typed_messages_adapter(rows)


def ultrachat_200k_adapter(rows: DataFrame) -> DataFrame:
    """Rows whose prompt is the first user message and that hold only user and assistant turns."""
    found = messages_adapter(rows)
    strings = F.when(F.col("prompt").isNull(), "prompt must be a string").when(F.col("prompt_id").isNull(), "prompt_id must be a string")
    first = F.get("messages", F.lit(0))
    own = F.when(first["role"] != "user", "first message must be user").when(F.get(first["parts"], F.lit(0))["value"] != F.col("prompt"), "prompt must equal the first user message")
    own = own.when(F.exists("messages", lambda m: ~m["role"].isin("user", "assistant")), "only user and assistant roles are supported")
    return found.withColumn("reason", F.coalesce(strings, "reason", own))


def prompt_completion_adapter(rows: DataFrame) -> DataFrame:
    """Two strings as a user and an assistant message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    bad = F.when(F.col("prompt").isNull() | F.col("completion").isNull(), "prompt and completion must be strings")
    found = messages_adapter(rows.withColumn("messages", F.array(message("user", "prompt"), message("assistant", "completion"))))
    return found.withColumn("reason", F.coalesce(bad, "reason"))


def sharegpt_adapter(rows: DataFrame) -> DataFrame:
    """conversations under the other dialect's names, (from, value) or any that messages may have; nothing but them and id survives."""
    return messages_adapter(rows.select("id", F.col("conversations").alias("messages")))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "messages": messages_adapter,
    "ultrachat_200k": ultrachat_200k_adapter,
    "prompt_completion": prompt_completion_adapter,
    "sharegpt": sharegpt_adapter,
}


def get_adapter(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; known: {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def reason_counts(adapted: DataFrame) -> DataFrame:
    """reason (at most 240 characters), rows of the rejected rows."""
    return adapted.where("reason is not null").groupBy(F.left("reason", F.lit(240)).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
