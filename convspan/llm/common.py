"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five ASCII control characters that end a word.
SPACES = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch between the JVM and Python, at most; with the default of 10,000 a batch of long texts is tens of MB on both sides.
ARROW_ROWS = 1_000
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names in spark.checkpoint.dir.

    Where none is named, one machine that is driver and executors in one (tests) gets a temporary one; a cluster has to name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder and read back; its lineage ends there."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def small_arrow_batches(frame: DataFrame) -> None:
    """Asks the session for Arrow batches of at most ARROW_ROWS rows, as texts are long; fewer stay as they are."""
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened as long as the frame has a column of that name."""
    taken = {c.lower() for c in frame.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def row_key(frame: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with two more columns, longs, and their names; together they are alike for rows that agree in all columns, nulls
    included, else different (128 bits of hashes)."""
    parts = [x for c in frame.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    names = unused(frame, "row_key_1", "row_key_2")
    return frame.withColumns({name: F.xxhash64(F.lit(k), *parts) for k, name in enumerate(names)}), names


#: Rows with one key from which a join sends them to no common task; rows (a few longs each) up to which a table is broadcast.
HUB_ROWS, BROADCAST_ROWS = 10_000, 500_000


def join_hubs(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left.join(right, key), where right has one row for each key and left has so many rows.

    Keys with more than HUB_ROWS rows of left get their rows of right by a broadcast, of rows / HUB_ROWS rows at most, so no task
    receives all rows of such a key. A table that has no room for one is joined as it is.
    """
    if rows <= HUB_ROWS or rows // HUB_ROWS > BROADCAST_ROWS:
        return left.join(right, key)
    hubs = left.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > HUB_ROWS).select(key)
    return left.join(F.broadcast(right.join(F.broadcast(hubs), key)), key).unionByName(left.join(F.broadcast(hubs), key, "left_anti").join(right, key))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its user sets in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(frame: DataFrame, rows: int, key: str) -> DataFrame:
    """At most `rows` rows, those whose key has the least hashes modulo the table's size; reruns agree.

    About twice as many pass a filter first, so what is sorted does not grow with the table or its partitions.
    """
    total = max(frame.count(), 1)
    order = F.pmod(F.xxhash64(key), F.lit(total))
    return frame.where(order < 2 * rows).orderBy(order, key).limit(rows)
