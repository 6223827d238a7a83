"""Deterministic order, rank slices, padded rows, micro-batches and the content-addressed batch tape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspan.functions import packing


def order_key(key: Column, seed: int, epoch: int = 0) -> Column:
    """A hash that orders samples differently for each seed and epoch, and alike in every engine."""
    return F.sha2(F.concat(F.lit(f"{seed + epoch}:"), key.cast("string")), 256)


def shuffled(samples: DataFrame, seed: int, epoch: int = 0, key: str = "sample_id") -> DataFrame:
    """samples with position, from 0, in the epoch's order.

    Positions are running counts within slices of the hash range plus the sizes of the slices before, so no task holds all samples.
    """
    rows = samples.withColumn("order", order_key(F.col(key), seed, epoch)).withColumn("slice", F.substring("order", 1, 3))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("size")).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    within = F.row_number().over(Window.partitionBy("slice").orderBy("order", key))
    return rows.join(slices, "slice").withColumn("position", F.col("offset") + within - 1).drop("order", "slice", "offset")


def rank_of(position: Column, world_size: int) -> Column:
    return F.pmod(position, F.lit(world_size))


def index_columns(flat: Column, accumulation: int, processes: int, devices: int, examples: int) -> dict[str, Column]:
    """A batch row's accumulation step, process, device and example; every row is on exactly one process."""
    e, d, p = examples, examples * devices, examples * devices * processes
    return {
        "step": F.floor(flat / (p * accumulation)), "accumulation": F.floor(flat / p) % accumulation, "process": F.floor(flat / d) % processes, "device": F.floor(flat / e) % devices, "example": flat % e,
    }


def number_emitted(rows: DataFrame, emitted: Column, order: tuple[str, ...] = ("epoch", "position"), by: tuple[str, ...] = ("rank",), width: int = 4096) -> DataFrame:
    """rows with emitted_index: how many emitted rows of the same by stand before an emitted one in the order; null for others.

    Ranges of width positions (the last column of order) are counted first, one row each, and their running sums join the counts within each
    range, so no task numbers all rows and rejected rows leave no gap, across epoch ends too.
    """
    keys = [*by, *order[:-1], "__range"]
    rows = rows.withColumns({"__yes": F.coalesce(emitted, F.lit(False)).cast("int"), "__range": F.floor(F.col(order[-1]) / width)})
    before = Window.partitionBy(*by).orderBy(*order[:-1], "__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys).agg(F.sum("__yes").alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    within = F.sum("__yes").over(Window.partitionBy(*keys).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__within", within).join(ranges, keys)
    return found.withColumn("emitted_index", F.when(F.col("__yes") == 1, F.col("__before") + F.col("__within") - 1)).drop("__yes", "__range", "__before", "__within")


#: What a batch is made of.
ARRAYS = ("input_ids", "attention_mask", "loss_weights")


def stack(rows: DataFrame, accumulation: int, devices: int, examples: int, by: tuple[str, ...] = ("rank",)) -> DataFrame:
    """by, batch, sample_ids and ARRAYS of every whole batch of rows(by, emitted_index, sample_id, ARRAYS), nested as [device, accumulation, example].

    Rows fill a batch accumulation by accumulation, in each device by device. A batch has accumulation * devices * examples rows; rows that
    make up no whole one are left for the next call.
    """
    size, k = accumulation * devices * examples, F.col("emitted_index")
    place = F.struct((F.floor(k / examples) % devices).alias("device"), (F.floor(k / (devices * examples)) % accumulation).alias("accumulation"), (k % examples).alias("example"))
    found = rows.where(k.isNotNull()).groupBy(*by, F.floor(k / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "sample_id", *ARRAYS))).alias("x")).where(F.size("x") == size)
    nest = lambda name: F.transform(F.sequence(F.lit(0), F.lit(devices - 1)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(accumulation - 1)), lambda a: F.transform(F.slice("x", (d * accumulation + a) * examples + 1, F.lit(examples)), lambda r: r[name])))
    return found.select(*by, "batch", nest("sample_id").alias("sample_ids"), *[nest(c).alias(c) for c in ARRAYS])


def padded(tokens: DataFrame, windows: DataFrame | None, length: int, pad_id: int = 0) -> DataFrame:
    """sample_id, input_ids, attention_mask, loss_weights of length each, from tokens within their sample's window [start, stop).

    Without windows the tokens bring theirs as from and to, and only those inside are there, as truncate.within_loss_aware gives them.
    """
    inside = tokens if windows is None else tokens.join(windows.select("sample_id", "start", "stop").withColumnsRenamed({"start": "from", "stop": "to"}), "sample_id").where("pos >= from and pos < to")
    weight = F.when(F.col("pos") == F.col("from"), 0.0).otherwise(F.col("weight"))
    rows = inside.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", weight.alias("weight")))).alias("t"))
    fill = lambda values, pad: F.concat(values, F.array_repeat(pad, F.lit(length) - F.size("t")))
    return rows.select(
        "sample_id", fill(F.transform("t", lambda x: x["token_id"]), F.lit(pad_id)).alias("input_ids"), fill(F.transform("t", lambda x: F.lit(True)), F.lit(False)).alias("attention_mask"),
        fill(F.transform("t", lambda x: x["weight"].cast("float")), F.lit(0.0).cast("float")).alias("loss_weights"),
    )


def placed(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Padded rows with their position in an order (sample_id, position), in the tasks in which they are dealt by sample.

    The order goes to the rows, by a merge: a small table's rows, by the size of its compressed files, would else be collected and broadcast to it,
    arrays and all, and stand in as few tasks as the order does.
    """
    return rows.join(order.hint("merge"), "sample_id")


def tape_faults(tape: DataFrame, length: int) -> DataFrame:
    """step, item, fault of every tape row that breaks a rule; empty for a sound tape."""
    size = (F.size("input_ids") != length) | (F.size("attention_mask") != length) | (F.size("loss_weights") != length)
    prefix = F.array_sort("attention_mask", lambda a, b: F.when(a == b, 0).when(a, -1).otherwise(1)) != F.col("attention_mask")
    pairs = F.arrays_zip("attention_mask", "loss_weights")
    fault = F.when(size, "a row has another length").when(prefix, "the mask is not a prefix").when(F.exists("loss_weights", lambda w: (w < 0) | F.isnan(w)), "a weight is negative or no number")
    fault = fault.when(F.exists(pairs, lambda p: ~p["attention_mask"] & (p["loss_weights"] != 0)), "padding has weight").when(F.get("loss_weights", F.lit(0)) != 0, "a first token has weight")
    return tape.select("step", "item", fault.alias("fault")).where("fault is not null")


def row_digest() -> Column:
    """Hash of the bytes of a tape row's three arrays, little-endian 32-bit integers, single bytes and 32-bit floats, one after another."""
    return packing.array_digest({"input_ids": "int", "attention_mask": "boolean", "loss_weights": "float"})


def write_tape(tape: DataFrame, path: str) -> None:
    """Writes a new tape, a folder per step, with a digest in every row; an existing one is never overwritten."""
    tape.withColumn("digest", row_digest()).write.mode("errorifexists").partitionBy("step").parquet(path)


def read_tape(spark, path: str) -> DataFrame:
    """A tape whose rows still have their digests; reading a changed row fails."""
    rows = spark.read.parquet(path)
    return rows.where(F.assert_true(F.col("digest") == row_digest(), F.lit("a tape row differs from its digest")).isNull()).drop("digest")


def flat_index(accumulation: int, processes: int, devices: int, examples: int) -> Column:
    """A row's number from its step, accumulation, process, device and example: the inverse of index_columns."""
    e, d, p = examples, examples * devices, examples * devices * processes
    return F.col("step") * (p * accumulation) + F.col("accumulation") * p + F.col("process") * d + F.col("device") * e + F.col("example")


def manifest(tape: DataFrame) -> DataFrame:
    """step, rows, identity of each step of a tape: the hash of its rows' digests in the order of their items, one row a step."""
    listed = F.array_sort(F.collect_list(F.struct("item", "digest")))
    return tape.select("step", "item", row_digest().alias("digest")).groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.transform(listed, lambda x: x["digest"]), ","), 256).alias("identity"))


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """step, item, fault of rows that a tape lacks, has beyond another, has twice, or has with other arrays."""
    own = lambda t, name: t.select("step", "item", row_digest().alias("digest")).groupBy("step", "item").agg(F.min("digest").alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))
    both = own(expected, "wanted").join(own(found, "present"), ["step", "item"], "full_outer")
    fault = F.when(F.col("present").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("present_rows") > 1, "twice").when(F.col("present") != F.col("wanted"), "changed")
    return both.select("step", "item", fault.alias("fault")).where("fault is not null")


def synthetic(spark: SparkSession, rows: int | DataFrame, length: int, vocabulary: int, seed: int) -> DataFrame:
    """item, input_ids, attention_mask, loss_weights of so many rows, or of those that a table(id) names, of made-up tokens; the last half of each carries weight."""
    token = lambda p: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), p.cast("string")), 256), 1, 8), 16, 10).cast("long") % vocabulary
    places = F.sequence(F.lit(0), F.lit(length - 1))
    return (spark.range(rows) if isinstance(rows, int) else rows).select(
        F.col("id").alias("item"), F.transform(places, lambda p: token(p).cast("int")).alias("input_ids"), F.transform(places, lambda p: F.lit(True)).alias("attention_mask"),
        F.transform(places, lambda p: F.when(p >= length // 2, 1.0).otherwise(0.0).cast("float")).alias("loss_weights"),
    )
