"""Batch tapes as a Spark data source: `spark.read.format("batch_tape")`, `frame.write.format("batch_tape")`.

A tape is a folder: parts/, Parquet files of (step, item, input_ids, attention_mask, loss_weights), and manifest.json, which says what the tape is and
holds the hash tree over it. A row's leaf is the hash of its step, item and arrays' bytes; a part's node the hash of its leaves in
order; the root the hash of parts, leaf sum and facts. Leaves also add up to one number that does not depend on how rows are
dealt into parts. Writing commits in two phases: tasks write parts under names of their own and tell the driver their nodes, and the driver
writes the manifest last, by a rename, after it has cleared what failed tasks left. A folder that exists is never written to.

Reading checks the manifest and the list of parts on the driver, and every part, row by row, in the task that reads it: a lost, added or
changed row or part fails the read, as does a tape of another recipe. The driver holds a line for each part, never rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from convspan.functions import packing

SCHEMA = "step bigint, item bigint, input_ids array<int>, attention_mask array<boolean>, loss_weights array<float>"
#: The arrays, their bytes in numpy's words and in those of packing.
ARRAYS = {"input_ids": ("<i4", "int"), "attention_mask": ("?", "boolean"), "loss_weights": ("<f4", "float")}
FACTS = {"recipe_identity", "model", "data", "tokenizer_identity", "pad_token_id", "stream_counters"}
FIELDS = FACTS | {"schema_version", "kind", "shape", "parts", "leaf_sum", "identity"}
MODEL, DATA = {"repo_id", "revision"}, {"repo_id", "revision", "config", "split", "adapter", "renderer", "loading_mode"}
#: Rows of a batch that is written or read at once.
ROWS = 1000
#: Bytes of arrays that a part has, about, and those of one place of a row: a part is read whole, so larger tapes have more parts.
PART_BYTES, PLACE_BYTES = 4_000_000, 9
MODULUS = 1 << 256


class TapeError(ValueError):
    """A tape that is not what its manifest says."""


def leaf() -> Column:
    """A row's leaf as a column, equal to what the source computes."""
    return packing.digest(*(F.unhex(packing.digits(F.col(c), "bigint")) for c in ("step", "item")), *(packing.packed(F.col(c), kind) for c, (_, kind) in ARRAYS.items()))


def _leaves(batch: pa.RecordBatch) -> list[bytes]:
    arrays = [_matrix(batch.column(c), kind) for c, (kind, _) in ARRAYS.items()]
    places = np.stack([np.asarray(batch.column(c), "<i8") for c in ("step", "item")], 1)
    return [hashlib.sha256(b"".join((p.tobytes(), *(a[i].tobytes() for a in arrays)))).digest() for i, p in enumerate(places)]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The rows of an array column side by side; they have one length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (column.null_count or (sizes != sizes[0]).any()):
        raise TapeError("rows have different lengths")
    flat = column.flatten()
    if flat.null_count:
        raise TapeError("an array has nulls")
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(sizes), -1)


def row_faults(batch: pa.RecordBatch, length: int) -> None:
    """Fails on the first rule of a tape that a row of the batch breaks."""
    ids, mask, weights = (_matrix(batch.column(c), kind) for c, (kind, _) in ARRAYS.items())
    if any(a.shape[1] != length for a in (ids, mask, weights)):
        raise TapeError(f"a row is not of length {length}")
    rules = {
        "an id is negative": ids < 0, "a mask is no prefix": mask[:, 1:] & ~mask[:, :-1], "a weight is negative or not finite": ~np.isfinite(weights) | (weights < 0),
        "padding has weight": (weights != 0) & ~mask, "a first token has weight": weights[:, :1] != 0,
    }
    for fault, broken in rules.items():
        if broken.any():
            raise TapeError(f"{fault} in item {batch.column('item')[int(np.argwhere(broken)[0][0])].as_py()}")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def identity(manifest: dict) -> str:
    material = {k: v for k, v in manifest.items() if k != "identity"}
    return hashlib.sha256(b"convspan-tape\0" + canonical(material).encode()).hexdigest()


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _hex(value: object, what: str) -> None:
    if not isinstance(value, str) or len(value) != 64 or set(value) - set("0123456789abcdef"):
        raise TapeError(f"the {what} is no SHA-256")


def checked_facts(facts: dict) -> dict:
    """What a tape is made of, with every field of its kind."""
    if set(facts) != FACTS:
        raise TapeError(f"a tape's facts are {sorted(FACTS)}")
    for name, fields in (("model", MODEL), ("data", DATA)):
        if not isinstance(facts[name], dict) or set(facts[name]) != fields or not all(isinstance(v, str) and v for v in facts[name].values()):
            raise TapeError(f"{name} has to have {sorted(fields)}, texts with characters")
    _hex(facts["recipe_identity"], "recipe's identity")
    _hex(facts["tokenizer_identity"], "tokenizer's identity")
    if isinstance(facts["pad_token_id"], bool) or not isinstance(facts["pad_token_id"], int) or facts["pad_token_id"] < 0:
        raise TapeError("the padding token is no id")
    if not isinstance(facts["stream_counters"], dict):
        raise TapeError("the counters are no mapping")
    return facts


def read_manifest(path: str, recipe_identity: str | None = None) -> dict:
    """The manifest of a tape after all checks that need no rows: fields, identity, recipe, shape, and that its parts are there and no others."""
    store, root = _store(path)
    if store.get_file_info(f"{root}/manifest.json").type != pafs.FileType.File:
        raise TapeError(f"{path} has no manifest")
    with store.open_input_stream(f"{root}/manifest.json") as stream:
        manifest = json.loads(stream.read())
    if not isinstance(manifest, dict) or set(manifest) != FIELDS or manifest["kind"] != "batch_tape" or manifest["schema_version"] != 1:
        raise TapeError("the manifest is none of a tape of version 1")
    if manifest["identity"] != identity(manifest):
        raise TapeError("the manifest's identity is not that of its fields")
    checked_facts({k: manifest[k] for k in FACTS})
    if recipe_identity and manifest["recipe_identity"] != recipe_identity:
        raise TapeError("the tape is of another recipe")
    shape = manifest["shape"]
    if set(shape) != {"steps", "batch_size", "length"} or min(shape.values()) <= 0 or shape["length"] < 2:
        raise TapeError("the shape is none")
    if sum(p["rows"] for p in manifest["parts"]) != shape["steps"] * shape["batch_size"] or sum(int(p["leaf_sum"], 16) for p in manifest["parts"]) % MODULUS != int(manifest["leaf_sum"], 16):
        raise TapeError("parts do not add up to the tape")
    there = {f.base_name for f in store.get_file_info(pafs.FileSelector(f"{root}/parts")) if not f.base_name.startswith(".")}
    named = {p["name"] for p in manifest["parts"]}
    if there != named:
        raise TapeError(f"{len(named - there)} parts are lost and {len(there - named)} are none of the tape's")
    return manifest


@dataclass
class Part(InputPartition):
    """A part to read, and what of it; the reader that plans is another object than those that read."""

    name: str
    rows: int
    node: str
    length: int
    first_step: int
    last_step: int


class TapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.recipe = options["path"], options.get("recipe_identity")
        self.first, self.last = int(options.get("first_step", 0)), int(options["last_step"]) if "last_step" in options else None

    def partitions(self) -> list[Part]:
        manifest = read_manifest(self.path, self.recipe)
        length = manifest["shape"]["length"]
        last = manifest["shape"]["steps"] - 1 if self.last is None else self.last
        if not 0 <= self.first <= last + 1 or last >= manifest["shape"]["steps"]:
            raise TapeError("steps outside the tape are asked for")
        wanted = [Part(p["name"], p["rows"], p["node"], length, self.first, last) for p in manifest["parts"] if p["first_step"] <= last and p["last_step"] >= self.first]
        return wanted or [Part("", 0, "", length, 0, -1)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        store, root = _store(self.path)
        node, rows = hashlib.sha256(), 0
        # All of the part is checked before any of its rows are given on: a part is as large as one task wrote it.
        kept = []
        with store.open_input_file(f"{root}/parts/{part.name}") as source:
            for batch in pq.ParquetFile(source).iter_batches(ROWS):
                row_faults(batch, part.length)
                for one in _leaves(batch):
                    node.update(one)
                rows += batch.num_rows
                kept.append(batch)
        if (rows, node.hexdigest()) != (part.rows, part.node):
            raise TapeError(f"part {part.name} has other rows than its manifest says")
        for batch in kept:
            steps = np.asarray(batch.column("step"))
            inside = (steps >= part.first_step) & (steps <= part.last_step)
            yield batch if inside.all() else batch.filter(pa.array(inside))


@dataclass
class Written(WriterCommitMessage):
    part: dict | None


class TapeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.facts, self.shape = options["path"], checked_facts(json.loads(options["facts"])), json.loads(options["shape"])
        store, root = _store(self.path)
        if overwrite or store.get_file_info(root).type != pafs.FileType.NotFound:
            raise TapeError(f"{self.path} exists, and tapes are not overwritten")
        store.create_dir(f"{root}/parts", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        name = f"{uuid.uuid4().hex}.parquet"
        node, rows, total, low, high, sink, batch_rows = hashlib.sha256(), 0, 0, None, None, None, []
        schema = pa.schema([("step", pa.int64()), ("item", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("attention_mask", pa.list_(pa.bool_())), ("loss_weights", pa.list_(pa.float32()))])

        def flush() -> None:
            nonlocal rows, total, low, high, sink
            batch = pa.RecordBatch.from_pylist(batch_rows, schema)
            batch_rows.clear()
            row_faults(batch, self.shape["length"])
            for one in _leaves(batch):
                node.update(one)
                total = (total + int.from_bytes(one, "big")) % MODULUS
            steps = np.asarray(batch.column("step"))
            low, high = int(steps.min()) if low is None else min(low, int(steps.min())), int(steps.max()) if high is None else max(high, int(steps.max()))
            rows += batch.num_rows
            sink = sink or pq.ParquetWriter(store.open_output_stream(f"{root}/parts/{name}"), schema)
            sink.write_batch(batch)

        for row in iterator:
            batch_rows.append(row.asDict())
            if len(batch_rows) >= ROWS:
                flush()
        if batch_rows:
            flush()
        if sink is None:
            return Written(None)
        sink.close()
        return Written({"name": name, "rows": rows, "node": node.hexdigest(), "leaf_sum": f"{total:064x}", "first_step": low, "last_step": high})

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        parts = sorted((m.part for m in messages if m is not None and m.part), key=lambda p: (p["first_step"], p["name"]))
        named = {p["name"] for p in parts}
        for f in store.get_file_info(pafs.FileSelector(f"{root}/parts")):
            if f.base_name not in named:  # of attempts that failed
                store.delete_file(f.path)
        if sum(p["rows"] for p in parts) != self.shape["steps"] * self.shape["batch_size"]:
            raise TapeError("the rows written are not those of the shape")
        manifest = self.facts | {"schema_version": 1, "kind": "batch_tape", "shape": self.shape, "parts": parts, "leaf_sum": f"{sum(int(p['leaf_sum'], 16) for p in parts) % MODULUS:064x}"}
        manifest["identity"] = identity(manifest)
        with store.open_output_stream(f"{root}/manifest.tmp") as sink:
            sink.write((json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode())
        store.move(f"{root}/manifest.tmp", f"{root}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.delete_dir_contents(f"{root}/parts", missing_dir_ok=True)


class TapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_tape"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TapeReader:
        return TapeReader(self.options)

    def writer(self, schema, overwrite: bool) -> TapeWriter:
        return TapeWriter(self.options, overwrite)


def step_faults(tape: DataFrame, batch_size: int) -> DataFrame:
    """step, fault of steps that have not batch_size rows with items 0 to batch_size - 1, or no weight behind first tokens."""
    weight = F.aggregate(F.slice("loss_weights", F.lit(2), F.greatest(F.size("loss_weights") - 1, F.lit(0))), F.lit(0.0), lambda a, w: a + w)
    found = tape.groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item").alias("items"), F.min("item").alias("low"), F.max("item").alias("high"), F.sum(weight).alias("weight"))
    fault = F.when((F.col("rows") != batch_size) | (F.col("items") != batch_size) | (F.col("low") != 0) | (F.col("high") != batch_size - 1), "a step has not its items once").when(~(F.col("weight") > 0), "a step has no weight")
    return found.select("step", fault.alias("fault")).where("fault is not null")


def write_tape(tape: DataFrame, path: str, facts: dict, steps: int, batch_size: int, length: int) -> dict:
    """Writes a new tape of (step, item, arrays) and returns its manifest; steps stay together in parts. Faulty steps are refused first."""
    spark = tape.sparkSession
    spark.dataSource.register(TapeSource)
    if bad := step_faults(tape, batch_size).orderBy("step").first():
        raise TapeError(f"step {bad.step}: {bad.fault}")
    shape = {"steps": steps, "batch_size": batch_size, "length": length}
    parts = max(1, -(-steps * batch_size * length * PLACE_BYTES // PART_BYTES))
    rows = tape.select(F.col("step").cast("long"), F.col("item").cast("long"), *ARRAYS).repartitionByRange(parts, "step").sortWithinPartitions("step", "item")
    rows.write.format("batch_tape").mode("append").option("facts", json.dumps(facts)).option("shape", json.dumps(shape)).option("path", path).save()
    return read_manifest(path)


def read_tape(spark: SparkSession, path: str, recipe_identity: str | None = None, first_step: int = 0, last_step: int | None = None) -> DataFrame:
    """The rows of a tape's steps; only the parts that hold them are read."""
    spark.dataSource.register(TapeSource)
    options = {"path": path, "first_step": str(first_step)} | ({"recipe_identity": recipe_identity} if recipe_identity else {}) | ({} if last_step is None else {"last_step": str(last_step)})
    return spark.read.format("batch_tape").options(**options).load()


@dataclass(frozen=True)
class TapeCursor:
    """Where a run stands on a tape."""

    identity: str
    next_step: int

    def save(self) -> dict:
        return {"schema_version": 1, "kind": "batch_tape", "identity": self.identity, "next_step": self.next_step}

    @classmethod
    def load(cls, raw: object, manifest: dict, expected_step: int) -> TapeCursor:
        if not isinstance(raw, dict) or set(raw) != {"schema_version", "kind", "identity", "next_step"} or (raw["schema_version"], raw["kind"]) != (1, "batch_tape"):
            raise ValueError("the saved state is none of a tape")
        if raw["identity"] != manifest["identity"]:
            raise ValueError("the saved state is of another tape")
        if raw["next_step"] != expected_step or not 0 <= expected_step <= manifest["shape"]["steps"]:
            raise ValueError("the saved state stands at another step")
        return cls(raw["identity"], expected_step)

    def rest(self, spark: SparkSession, path: str) -> DataFrame:
        """The rows of the steps from here on."""
        return read_tape(spark, path, first_step=self.next_step)
