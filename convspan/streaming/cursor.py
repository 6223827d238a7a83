"""Endless, resumable sample order over epochs, and ingestion of message files as they arrive."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspan.operators import batch


@dataclass(frozen=True)
class Cursor:
    """Where a rank stands: rows it has taken in its epoch, and what must not change between save and resume."""

    epoch: int
    rows_in_epoch: int
    rank: int
    world_size: int
    seed: int
    tokenizer: str
    schema_version: int = 3

    def state(self) -> dict:
        return asdict(self)

    @classmethod
    def load(cls, state: dict, now: Cursor) -> Cursor:
        """The saved cursor, if it was saved by the same rank, world, seed and tokenizer."""
        if set(state) != set(now.state()):
            raise ValueError("the saved state has other fields")
        for name in ("schema_version", "rank", "world_size", "seed", "tokenizer"):
            if state[name] != getattr(now, name):
                raise ValueError(f"the saved state has another {name}")
        return cls(**state)


def take(samples: DataFrame, cursor: Cursor, rows: int, size: int) -> DataFrame:
    """The next rows of a cursor's rank as (epoch, position, ...), across epoch ends; size is the number of samples.

    Each epoch has its own order. A rank has the positions that leave its number when divided by the world's size.
    """
    per_epoch = -(-(size - cursor.rank) // cursor.world_size)
    found, epoch, skip = None, cursor.epoch, cursor.rows_in_epoch
    if rows <= 0 or per_epoch <= 0:
        return batch.shuffled(samples, cursor.seed, epoch).withColumn("epoch", F.lit(epoch)).limit(0)
    while rows > 0:
        here = min(rows, per_epoch - skip)
        first = cursor.rank + skip * cursor.world_size
        own = batch.shuffled(samples, cursor.seed, epoch).where((batch.rank_of(F.col("position"), cursor.world_size) == cursor.rank) & F.col("position").between(first, first + (here - 1) * cursor.world_size))
        own = own.withColumn("epoch", F.lit(epoch))
        found = own if found is None else found.unionByName(own)
        rows, epoch, skip = rows - here, epoch + 1, 0
    return found


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Message rows of Parquet files as they arrive in a folder; per-row work on them runs as on a table."""
    return spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(folder)


def role_counts(messages: DataFrame) -> DataFrame:
    """Running counts of messages and characters by role."""
    return messages.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))
