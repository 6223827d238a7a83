"""Turns that arrive in any order, some twice, over a stream that is killed and started again."""

import time
from datetime import datetime, timedelta

import pytest
from convspan.streaming import assembly

pytest.importorskip("google.protobuf")
SCHEMA = "conv_id long, turn long, role string, text string, n_turns long, arrived timestamp"
BEGAN = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, assembly.PROVIDER)
    yield
    spark.conf.set(name, before)


def put(spark, folder, number, rows):
    made = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}", n, BEGAN + timedelta(minutes=m)) for c, t, n, m in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")


def started(spark, tmp_path, once):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    writer = assembly.assemble(stream, "10 minutes", 600_000).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()


def test_killed_between_batches(spark, store, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, 0, [(1, 0, 3, 0), (2, 1, 2, 1), (3, 0, 2, 1), (1, 2, 3, 2)])
    put(spark, folder, 1, [(2, 1, 2, 3), (2, 0, 2, 3), (4, 0, 4, 3)])
    query = started(spark, tmp_path, once=False)
    for _ in range(240):
        if query.lastProgress and query.lastProgress["batchId"] >= 1 or query.exception():
            break
        time.sleep(0.25)
    query.stop()  # with conversations 1, 3 and 4 held in state
    put(spark, folder, 2, [(1, 1, 3, 5), (1, 0, 3, 5), (3, 1, 2, 6), (2, 0, 2, 6)])
    put(spark, folder, 3, [(9, 0, 1, 60)])  # moves the watermark past conversation 4
    put(spark, folder, 4, [(9, 0, 1, 61)])
    query = started(spark, tmp_path, once=True)
    query.awaitTermination(240)
    assert query.exception() is None
    got = {r.conv_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) == 5  # each comes once
    want = {r.conv_id: r for r in assembly.assembled_batch(spark.read.schema(SCHEMA).parquet(*[f"{folder}/{k}" for k in range(5)])).collect()}
    for c, r in want.items():
        assert (got[c].complete, got[c].n_turns, got[c].messages) == (r.complete, r.n_turns, r.messages), c
    assert not got[4].complete and got[4].n_turns == 1 and got[2].repeated == 1
