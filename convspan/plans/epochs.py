"""Queries on streams over epochs: resuming from an order on disk, batches of the rows that are emitted; each beside its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convspan.operators import batch
from convspan.plans.oracle import CLASSES, PADDED, _windows
from convspan.sources import tables
from convspan.sources.stage import shared_folder
from convspan.streaming import order_index
from convspan.streaming.cursor import Cursor

SEED, EPOCHS, RANKS = 17, 3, 2
ACCUMULATION, DEVICES, EXAMPLES = 2, 2, 2


def _index(spark, sf_dir) -> order_index.OrderIndex:
    """An index of the conversations by EPOCHS epochs, in slices small enough that there are some."""
    path = f"{shared_folder(spark)}/order-{uuid.uuid4().hex}"
    order_index.write(tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id")), path, SEED, EPOCHS, slice_rows=64)
    return order_index.OrderIndex.load(spark, path)


def indexed_resume(spark, sf_dir):
    """What rank 1 of 4 takes from 3 rows into its first epoch, for two epochs and a half, read from the slices behind its cursor."""
    index = _index(spark, sf_dir)
    return index.take(spark, Cursor(0, 3, 1, 4, SEED, "words"), max(index.per_epoch(1, 4), 1) * 5 // 2).select(F.col("epoch").cast("long"), "sample_id", "position")


def emitted_batches(spark, sf_dir):
    """Rows of the whole batches of every rank over all epochs: rejected rows take no place in a batch."""
    from convspan.plans.catalogue import _classified, _padded

    order = None
    index = _index(spark, sf_dir)
    for rank in range(RANKS):
        own = index.take(spark, Cursor(0, 0, rank, RANKS, SEED, "words"), EPOCHS * index.per_epoch(rank, RANKS)).withColumn("rank", F.lit(rank))
        order = own if order is None else order.unionByName(own)
    emitted = _classified(spark, sf_dir).where("class = 'emitted'").select("sample_id").join(_padded(spark, sf_dir), "sample_id")
    numbered = batch.number_emitted(order.join(emitted.withColumn("emitted", F.lit(True)), "sample_id", "left"), F.col("emitted"), width=32)
    found = batch.stack(numbered, ACCUMULATION, DEVICES, EXAMPLES)
    for level in ("device", "accumulation", "example"):
        zipped = F.arrays_zip("sample_ids", "input_ids", "loss_weights")
        kept = [c for c in ("rank", "batch", "device", "accumulation") if c in found.columns]
        found = found.select(*kept, F.posexplode(zipped).alias(level, "x")).select(*kept, level, F.col("x.sample_ids").alias("sample_ids"), F.col("x.input_ids").alias("input_ids"), F.col("x.loss_weights").alias("loss_weights"))
    ids = F.aggregate(F.transform("input_ids", lambda x, p: x.cast("long") * (p + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    weight = F.aggregate("loss_weights", F.lit(0.0), lambda a, w: a + w)
    return found.select(*[F.col(c).cast("long") for c in ("rank", "batch", "device", "accumulation", "example")], F.col("sample_ids").alias("sample_id"), ids.alias("ids"), weight.alias("weight"))


def queries() -> dict:
    return {f.__name__: f for f in (indexed_resume, emitted_batches)}


ORDERS = "orders AS (SELECT epoch, conv_id AS sample_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256((17 + epoch) || ':' || conv_id), conv_id) - 1 AS position FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT range AS epoch FROM range(3)))"
SQL = {
    "indexed_resume": f"WITH {ORDERS}, own AS (SELECT *, row_number() OVER (ORDER BY epoch, position) - 1 AS k, count(*) OVER () // 3 AS per FROM orders WHERE position % 4 = 1) SELECT epoch, sample_id, position FROM own WHERE k >= 3 AND k < 3 + greatest(per, 1) * 5 // 2",
    "emitted_batches": f"WITH {CLASSES}, {PADDED.removeprefix(_windows(0)).removeprefix(', ')}, {ORDERS}, f AS (SELECT sample_id, sum(token_id * (place + 1)) AS ids, sum(weight) AS weight FROM inside GROUP BY 1), "
                       "e AS (SELECT position % 2 AS rank, sample_id, row_number() OVER (PARTITION BY position % 2 ORDER BY epoch, position) - 1 AS k FROM orders JOIN classed USING (sample_id) WHERE class = 'emitted'), n AS (SELECT rank, count(*) // 8 * 8 AS whole FROM e GROUP BY 1) "
                       "SELECT rank, k // 8 AS batch, k // 2 % 2 AS device, k // 4 % 2 AS accumulation, k % 2 AS example, sample_id, CAST(ids AS BIGINT) AS ids, CAST(weight AS DOUBLE) AS weight FROM e JOIN n USING (rank) JOIN f USING (sample_id) WHERE k < whole",
}
