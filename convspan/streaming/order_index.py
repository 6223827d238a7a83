"""The order of samples by epochs on disk, so that a cursor resumes by reading the slices behind it and no epoch is sorted again.

A folder holds order/ (position, sample_id, partitioned by epoch and slice, each slice one range of positions), directory/ (epoch, slice, size, offset) and
index.json, which is written last and names seed, samples and slices. Ranks differ only in which positions they take.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspan.operators import batch
from convspan.sources import files
from convspan.streaming.cursor import Cursor

#: Samples of a slice, about, and slices of an epoch at most: hexadecimal digits of the order's hash.
SLICE_ROWS, DIGITS = 100_000, 4
#: Counters of a stream's state: what rows became, and sums over what truncation left out.
CLASSES = ("rows_emitted", "adapter_errors", "length_rejections", "semantic_truncation_rejections", "zero_objective")
SUMS = ("truncated_samples", "semantic_truncated_samples", "tokens_truncated", "selected_tokens_truncated", "selected_weight_truncated", "messages_truncated", "tool_atomic_units_retained", "context_constraint_relaxations")
COUNTERS = ("rows_seen", "rows_seen_in_epoch", *CLASSES, *SUMS, "epochs")


def write(samples: DataFrame, path: str, seed: int, epochs: int, key: str = "sample_id", slice_rows: int = SLICE_ROWS) -> None:
    """A new index of so many epochs over the different keys of samples; one shuffle an epoch, by slices."""
    spark = samples.sparkSession
    if files.exists(spark, path):
        raise ValueError(f"{path} exists")
    keys = samples.select(F.col(key).alias("sample_id")).distinct()
    size = keys.count()
    digits = next((d for d in range(DIGITS) if size <= slice_rows * 16**d), DIGITS)
    for epoch in range(epochs):
        rows = keys.withColumn("order", batch.order_key(F.col("sample_id"), seed, epoch)).withColumn("slice", F.conv(F.concat(F.lit("0"), F.substring("order", 1, digits)), 16, 10).cast("int"))
        slices = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("size"))
        before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice, 16 ** DIGITS at most
        slices = slices.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("epoch", F.lit(epoch))
        slices.coalesce(1).write.mode("append").parquet(f"{path}/directory")
        within = F.row_number().over(Window.partitionBy("slice").orderBy("order", "sample_id"))
        placed = rows.withColumn("within", within).join(F.broadcast(spark.read.parquet(f"{path}/directory").where(F.col("epoch") == epoch)), "slice")
        placed.select((F.col("offset") + F.col("within") - 1).alias("position"), "sample_id", "epoch", "slice").write.mode("append").partitionBy("epoch", "slice").parquet(f"{path}/order")
    about = {"kind": "order_index", "seed": seed, "samples": size, "epochs": epochs, "slices": 16**digits}
    files.write_json(spark, f"{path}/index.json", about)


@dataclass(frozen=True)
class OrderIndex:
    path: str
    seed: int
    samples: int
    epochs: int
    slices: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OrderIndex:
        about = files.read_json(spark, f"{path}/index.json")
        if about.pop("kind", None) != "order_index" or set(about) != {"seed", "samples", "epochs", "slices"}:
            raise ValueError(f"{path} is no order index")
        return cls(path, **about)

    def per_epoch(self, rank: int, world_size: int) -> int:
        return max(-(-(self.samples - rank) // world_size), 0)

    def take(self, spark: SparkSession, cursor: Cursor, rows: int) -> DataFrame:
        """epoch, position, sample_id of the next rows of a cursor's rank, across epoch ends, read from the slices that hold them alone."""
        if cursor.seed != self.seed:
            raise ValueError("the cursor's seed is not that of the index")
        per_epoch = self.per_epoch(cursor.rank, cursor.world_size)
        if cursor.rows_in_epoch > per_epoch:
            raise ValueError(f"an epoch has {per_epoch} rows for this rank, and the cursor stands behind {cursor.rows_in_epoch}")
        order = spark.read.parquet(f"{self.path}/order")
        wanted, epoch, skip = F.lit(False), cursor.epoch, cursor.rows_in_epoch
        while rows > 0 and per_epoch > 0:
            here = min(rows, per_epoch - skip)
            if here and epoch >= self.epochs:
                raise ValueError(f"epoch {epoch} is not in the index of {self.epochs}")
            if here:
                first = cursor.rank + skip * cursor.world_size
                last = first + (here - 1) * cursor.world_size
                low, high = self._slices(spark, epoch, first, last)
                wanted |= (F.col("epoch") == epoch) & F.col("slice").between(low, high) & F.col("position").between(first, last)
            rows, epoch, skip = rows - here, epoch + 1, 0
        return order.where(wanted & (batch.rank_of(F.col("position"), cursor.world_size) == cursor.rank)).select("epoch", "position", "sample_id")

    def _slices(self, spark: SparkSession, epoch: int, first: int, last: int) -> tuple[int, int]:
        """The first and last slice with these positions, by the directory alone."""
        inside = (F.col("epoch") == epoch) & (F.col("offset") <= last) & (F.col("offset") + F.col("size") > first)
        found = spark.read.parquet(f"{self.path}/directory").where(inside).agg(F.min("slice").alias("low"), F.max("slice").alias("high")).first()
        return found.low, found.high


@dataclass(frozen=True)
class StreamState:
    """All that a rank needs to go on: its cursor, and the counters so far. It is refused unless it adds up and was saved by the same run."""

    cursor: Cursor
    loading_mode: str = "materialized"
    counters: dict = field(default_factory=dict)
    reasons: dict = field(default_factory=dict)

    def save(self) -> str:
        state = {"kind": "stream_state", "loading_mode": self.loading_mode, "cursor": self.cursor.state(), "counters": self.counters, "adapter_errors_by_reason": self.reasons}
        return json.dumps(state, sort_keys=True)

    @classmethod
    def load(cls, text: str, now: StreamState) -> StreamState:
        raw = json.loads(text)
        if set(raw) != {"kind", "loading_mode", "cursor", "counters", "adapter_errors_by_reason"} or raw["kind"] != "stream_state":
            raise ValueError("the saved state has other fields")
        if raw["loading_mode"] != now.loading_mode:
            raise ValueError("the saved state has another loading_mode")
        cursor, counters, reasons = Cursor.load(raw["cursor"], now.cursor), raw["counters"], raw["adapter_errors_by_reason"]
        if set(counters) != set(COUNTERS):
            raise ValueError("the saved state has other counters")
        if any(v < 0 for v in (*counters.values(), *reasons.values())):
            raise ValueError("a counter is negative")
        if counters["rows_seen_in_epoch"] > counters["rows_seen"]:
            raise ValueError("more rows were seen in the epoch than in all")
        if counters["adapter_errors"] != sum(reasons.values()):
            raise ValueError("reasons do not add up to the adapter's errors")
        if sum(counters[c] for c in CLASSES) != counters["rows_seen"]:
            raise ValueError("classes do not add up to the rows seen")
        if (cursor.epoch, cursor.rows_in_epoch) != (counters["epochs"], counters["rows_seen_in_epoch"]):
            raise ValueError("cursor and counters stand at different rows")
        return cls(cursor, raw["loading_mode"], counters, reasons)

    def after(self, rows: list[dict], counted: dict, reasons: dict) -> StreamState:
        """The state after rows (each with its epoch, in order), whose counters are counted, those of their own alone."""
        if not rows:
            return self
        epoch = rows[-1]["epoch"]
        here = sum(r["epoch"] == epoch for r in rows) + (self.cursor.rows_in_epoch if epoch == self.cursor.epoch else 0)
        summed = {c: self.counters.get(c, 0) + counted.get(c, 0) for c in (*CLASSES, *SUMS)}
        counters = summed | {"rows_seen": self.counters.get("rows_seen", 0) + len(rows), "rows_seen_in_epoch": here, "epochs": epoch}
        moved = Cursor(**(asdict(self.cursor) | {"epoch": epoch, "rows_in_epoch": here}))
        return StreamState(moved, self.loading_mode, counters, {k: self.reasons.get(k, 0) + reasons.get(k, 0) for k in {*self.reasons, *reasons}})
