"""Orders on disk: what a cursor reads, and states that are refused."""

import json
import re

import pytest

from convspan.sources import files
from convspan.streaming import cursor, order_index
from convspan.streaming.cursor import Cursor


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("order") / "index")
    order_index.write(spark.range(1000).withColumnRenamed("id", "sample_id"), path, 5, 2, slice_rows=70)
    return order_index.OrderIndex.load(spark, path)


def test_same_rows_as_sorting_anew(spark, index):
    assert index.slices == 16
    samples = spark.range(1000).withColumnRenamed("id", "sample_id")
    for start, rows in ((0, 10), (100, 30), (240, 60)):
        c = Cursor(0, start, 2, 4, 5, "t")
        want = [(r.epoch, r.position, r.sample_id) for r in cursor.take(samples, c, rows, 1000).orderBy("epoch", "position").collect()]
        assert [tuple(r) for r in index.take(spark, c, rows).orderBy("epoch", "position").collect()] == want
    assert index.take(spark, Cursor(0, 0, 0, 1, 5, "t"), 0).count() == 0


def test_only_slices_behind_the_cursor_are_read(spark, index):
    found = index.take(spark, Cursor(1, 30, 1, 4, 5, "t"), 10)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert re.search(r"PartitionFilters: \[[^\]]*slice", plan)
    assert 1 <= len(found.inputFiles()) and len(set(spark.read.parquet(f"{index.path}/order").inputFiles())) >= 32
    read = {r.slice for r in spark.read.parquet(f"{index.path}/order").join(found.select("position", "epoch"), ["position", "epoch"]).select("slice").distinct().collect()}
    assert len(read) <= 2


def test_refusals(spark, index, tmp_path):
    with pytest.raises(ValueError, match="epoch 2"):
        index.take(spark, Cursor(1, 240, 2, 4, 5, "t"), 20)
    with pytest.raises(ValueError, match="seed"):
        index.take(spark, Cursor(0, 0, 0, 4, 6, "t"), 1)
    with pytest.raises(ValueError, match="stands behind"):
        index.take(spark, Cursor(0, 251, 0, 4, 5, "t"), 1)
    with pytest.raises(ValueError, match="exists"):
        order_index.write(spark.range(3).withColumnRenamed("id", "sample_id"), index.path, 5, 1)
    with pytest.raises(FileNotFoundError):
        order_index.OrderIndex.load(spark, str(tmp_path))


def test_states(spark, index):
    now = order_index.StreamState(Cursor(0, 0, 1, 4, 5, "t"))
    rows = [r.asDict() for r in index.take(spark, now.cursor, 260).orderBy("epoch", "position").collect()]
    moved = now.after(rows, {"rows_emitted": 250, "adapter_errors": 3, "zero_objective": 7, "selected_weight_truncated": 1.5}, {"bad role": 2, "no messages": 1})
    assert (moved.cursor.epoch, moved.cursor.rows_in_epoch, moved.counters["rows_seen"]) == (1, 10, 260)
    assert order_index.StreamState.load(moved.save(), now) == moved
    more = [r.asDict() for r in index.take(spark, moved.cursor, 5).orderBy("position").collect()]
    assert {r["position"] for r in more} == {1 + 4 * k for k in range(10, 15)} and moved.after(more, {"rows_emitted": 5}, {}).counters["rows_seen_in_epoch"] == 15

    def changed(**change):
        raw = json.loads(moved.save())
        for name, value in change.items():
            (raw["cursor"] if name in raw["cursor"] else raw["counters"] if name in raw["counters"] else raw)[name] = value
        return json.dumps(raw)

    for change in ({"seed": 6}, {"rank": 2}, {"world_size": 8}, {"tokenizer": "u"}, {"loading_mode": "streaming"}, {"rows_seen": 259}, {"zero_objective": -7}, {"adapter_errors": 4}, {"rows_seen_in_epoch": 9}, {"epochs": 0}, {"kind": "other"}, {"more": 1}):
        with pytest.raises(ValueError):
            order_index.StreamState.load(changed(**change), now)


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "a" / "x.json")
    files.write_json(spark, path, {"é": [1, None]})
    assert files.read_json(spark, path) == {"é": [1, None]} and [p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".json"] == ["x.json"]
    with pytest.raises(ValueError, match="exists"):
        files.write_json(spark, path, 1)
    files.write_json(spark, path, 2, replace=True)
    assert files.read_json(spark, path) == 2
