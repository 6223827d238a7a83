"""Tapes by their data source: what is written is read, and nothing else."""

import hashlib
import json
import pathlib
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from convspan.operators import batch
from convspan.plans import runs
from convspan.sources import tape

SF = "/root/testdata/sf0.001"
RECIPE = hashlib.sha256(b"recipe").hexdigest()
FACTS = {
    "recipe_identity": RECIPE, "tokenizer_identity": hashlib.sha256(b"tokenizer").hexdigest(), "model": {"repo_id": "a/b", "revision": "1"}, "pad_token_id": 0, "stream_counters": {"rows_seen": 24},
    "data": {"repo_id": "c/d", "revision": "2", "config": "default", "split": "train", "adapter": "messages", "renderer": "olmo2", "loading_mode": "materialized"},
}
STEPS, SIZE, LENGTH = 6, 4, 5


def rows(spark, length=LENGTH):
    made = [(s, i, [s, i, 7, 0, 0][:length], [True, True, True, False, False][:length], [0.0, 0.5, i + 0.1, 0.0, 0.0][:length]) for s in range(STEPS) for i in range(SIZE)]
    return spark.createDataFrame(made, tape.SCHEMA)


@pytest.fixture
def written(spark, tmp_path):
    path = str(tmp_path / "tape")
    return path, tape.write_tape(rows(spark).repartition(5), path, FACTS, STEPS, SIZE, LENGTH)


def test_round_trip(spark, written):
    path, manifest = written
    assert sorted(map(tuple, tape.read_tape(spark, path, RECIPE).collect())) == sorted(map(tuple, rows(spark).collect()))
    assert manifest["shape"] == {"steps": STEPS, "batch_size": SIZE, "length": LENGTH} and sum(p["rows"] for p in manifest["parts"]) == STEPS * SIZE
    leaves = sum(int(r.x, 16) for r in rows(spark).select(tape.leaf().alias("x")).collect()) % tape.MODULUS
    assert f"{leaves:064x}" == manifest["leaf_sum"]  # by column functions as by the source


def test_identity_of_rows_does_not_depend_on_parts(spark, written, tmp_path):
    other = tape.write_tape(rows(spark).coalesce(1), str(tmp_path / "other"), FACTS, STEPS, SIZE, LENGTH)
    assert other["leaf_sum"] == written[1]["leaf_sum"]


def test_steps_and_cursor(spark, written):
    path, manifest = written
    assert {r.step for r in tape.read_tape(spark, path, first_step=2, last_step=3).collect()} == {2, 3}
    state = tape.TapeCursor(manifest["identity"], 4).save()
    found = tape.TapeCursor.load(state, manifest, 4)
    assert {r.step for r in found.rest(spark, path).collect()} == {4, 5} and tape.TapeCursor(manifest["identity"], 6).rest(spark, path).count() == 0
    for bad in (state | {"next_step": 5}, state | {"identity": "x"}, state | {"kind": "y"}, {"next_step": 4}, None):
        with pytest.raises(ValueError):
            tape.TapeCursor.load(bad, manifest, 4)
    with pytest.raises(Exception, match="outside"):
        tape.read_tape(spark, path, last_step=6).collect()


def changed(path, change):
    """A part with changed rows in the place of the first one."""
    part = sorted(pathlib.Path(path, "parts").glob("*.parquet"))[0]
    table = pq.read_table(part)
    pq.write_table(change(table), part)


def test_damage_is_seen(spark, written, tmp_path):
    path, manifest = written
    n = 0

    def fails(damage, match):
        nonlocal n
        n += 1
        copy = str(tmp_path / f"copy{n}")
        shutil.copytree(path, copy)
        damage(copy)
        with pytest.raises(Exception, match=match):
            tape.read_tape(spark, copy, RECIPE).collect()

    def edited(copy, **fields):
        name = f"{copy}/manifest.json"
        raw = json.load(open(name)) | fields
        json.dump(raw | {"identity": raw["identity"] if "identity" in fields or "keep" in fields else tape.identity(raw)}, open(name, "w"))

    first = lambda copy: sorted(pathlib.Path(copy, "parts").glob("*.parquet"))[0]
    fails(lambda c: changed(c, lambda t: t.slice(1)), "other rows")
    fails(lambda c: changed(c, lambda t: pa.concat_tables([t, t.slice(0, 1)])), "other rows")
    fails(lambda c: changed(c, lambda t: t.set_column(1, "item", pa.array([9] * len(t), "int64"))), "other rows")
    fails(lambda c: changed(c, lambda t: t.set_column(4, "loss_weights", pa.array([[0.0, -1.0, 0.0, 0.0, 0.0]] * len(t), pa.list_(pa.float32())))), "negative")
    fails(lambda c: first(c).unlink(), "lost")
    fails(lambda c: shutil.copy(first(c), f"{c}/parts/more.parquet"), "none of the tape's")
    fails(lambda c: pathlib.Path(c, "manifest.json").unlink(), "no manifest")
    fails(lambda c: edited(c, pad_token_id=1, identity=manifest["identity"]), "identity")
    fails(lambda c: edited(c, recipe_identity=hashlib.sha256(b"other").hexdigest()), "another recipe")
    fails(lambda c: edited(c, more=1), "version 1")
    fails(lambda c: edited(c, shape={"steps": 7, "batch_size": SIZE, "length": LENGTH}), "add up")
    fails(lambda c: edited(c, model={"repo_id": ""}), "model")


def test_what_is_not_written(spark, written, tmp_path):
    path, _ = written
    with pytest.raises(Exception, match="exists"):
        tape.write_tape(rows(spark), path, FACTS, STEPS, SIZE, LENGTH)
    new = lambda: str(tmp_path / hashlib.sha256(str(len(list(tmp_path.iterdir()))).encode()).hexdigest()[:8])
    for bad, match in ((rows(spark).where("item < 3"), "items once"), (rows(spark).withColumn("loss_weights", F.array_repeat(F.lit(0.0).cast("float"), 5)), "no weight"), (rows(spark).withColumn("item", F.col("item") % 2), "items once")):
        with pytest.raises(ValueError, match=match):
            tape.write_tape(bad, new(), FACTS, STEPS, SIZE, LENGTH)
    failed = new()
    with pytest.raises(Exception, match="mask is no prefix"):
        tape.write_tape(rows(spark).withColumn("attention_mask", F.array(*map(F.lit, (True, False, True, False, False)))), failed, FACTS, STEPS, SIZE, LENGTH)
    with pytest.raises(Exception, match="no manifest"):
        tape.read_tape(spark, failed).collect()
    for facts in (FACTS | {"recipe_identity": "x"}, FACTS | {"pad_token_id": -1}, FACTS | {"data": {}}, {}):
        with pytest.raises(Exception, match="identity|padding|data|facts"):
            tape.write_tape(rows(spark), new(), facts, STEPS, SIZE, LENGTH)


def test_rows_stay_in_the_tasks_in_which_they_are_dealt(spark):
    # A small table's arrays were broadcast to its order, and stood in one task.
    assert runs._tape(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    dealt = rows(spark).select((F.col("step") * SIZE + F.col("item")).alias("sample_id"), "input_ids").repartition(19, "sample_id")
    found = batch.placed(dealt, batch.shuffled(spark.range(STEPS * SIZE).withColumnRenamed("id", "sample_id"), 17))
    assert found.count() == STEPS * SIZE and found.rdd.getNumPartitions() == 19
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "input_ids" not in "".join(line for line in plan.splitlines() if "BroadcastExchange" in line)


def test_larger_tapes_have_more_parts(spark, tmp_path, monkeypatch):
    # Parts, which are read whole, were as many as the session's partitions, or fewer, whatever the tape's size.
    monkeypatch.setattr(tape, "PART_BYTES", SIZE * LENGTH * tape.PLACE_BYTES)
    manifest = tape.write_tape(rows(spark), str(tmp_path / "tape"), FACTS, STEPS, SIZE, LENGTH)
    assert len(manifest["parts"]) > STEPS // 2 and max(p["rows"] for p in manifest["parts"]) <= 2 * SIZE
    assert sorted(map(tuple, tape.read_tape(spark, str(tmp_path / "tape"), RECIPE).collect())) == sorted(map(tuple, rows(spark).collect()))


def test_audit_of_digests(spark):
    tape_rows = rows(spark).withColumn("loss_weights", F.when(F.col("item") == 3, F.array(F.lit(0.0), F.lit(float("nan")))).otherwise(F.col("loss_weights")).cast("array<float>"))
    at = F.col("step") * SIZE + F.col("item")
    other = tape_rows.where(at != 0).withColumn("input_ids", F.when(at == 5, F.array(F.lit(8))).otherwise(F.col("input_ids")))
    found = batch.audit(tape_rows, other.unionByName(other.where(at == 6)).unionByName(other.where(at == 7).withColumn("step", F.lit(99).cast("long"))))
    assert sorted(map(tuple, found.collect())) == [(0, 0, "missing"), (1, 1, "changed"), (1, 2, "twice"), (99, 3, "unexpected")]
    # Digests by column functions took milliseconds a row.
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
