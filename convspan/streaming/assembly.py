"""Conversations from turns that arrive one by one, in any order and some of them twice.

Turns are keyed by conversation; a key's turns, counts and timer live in the state store, so a stream that is restarted from its checkpoint
goes on with what it had, and each conversation is given out once. One that is not whole when the watermark has passed its last turn
by `wait` is given out as it is. State goes when its timer does: its size is that of the conversations of that time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
OUT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("complete", T.BooleanType()), T.StructField("n_turns", T.LongType()), T.StructField("repeated", T.LongType()), T.StructField("last_arrived", T.LongType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
])


class Assembler(StatefulProcessor):
    """Holds a conversation's turns until all that it announced are there, or its timer rings."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn bigint", "role string, text string")
        self.about = handle.getValueState("about", "expected bigint, held bigint, repeated bigint, latest bigint, done boolean")

    def _given(self, key: tuple, complete: bool) -> Row:
        expected, held, repeated, latest, _ = self.about.get()
        found = sorted((k[0], v[0], v[1]) for k, v in self.turns.iterator())
        return Row(conv_id=key[0], complete=complete, n_turns=held, repeated=repeated, last_arrived=latest, messages=[Row(role=r, text=t) for _, r, t in found])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        expected, held, repeated, latest, done = self.about.get() if self.about.exists() else (0, 0, 0, 0, False)
        for row in rows:
            latest = max(latest, int(row.arrived.timestamp() * 1000))
            if done or self.turns.containsKey((row.turn,)):
                repeated += 1
                continue
            self.turns.updateValue((row.turn,), (row.role, row.text))
            held, expected = held + 1, max(expected, row.n_turns or 0)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.wait_ms)
        whole = not done and expected and held >= expected
        self.about.update((expected, held, repeated, latest, done or bool(whole)))
        if whole:
            yield self._given(key, True)
            self.turns.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.about.exists():
            if not self.about.get()[4]:
                yield self._given(key, False)
            self.turns.clear()
            self.about.clear()

    def close(self) -> None:
        pass


def assemble(turns: DataFrame, wait: str = "1 hour", wait_ms: int = 3_600_000) -> DataFrame:
    """conv_id, complete, n_turns, repeated, last_arrived, messages of a stream (conv_id, turn, role, text, n_turns, arrived).

    A conversation comes once: whole, messages in the order of turns, as soon as n_turns different ones are there, or else when the watermark,
    `wait` behind the latest arrival, has passed its last one by wait_ms. The session has to use the state store PROVIDER.
    """
    keyed = turns.withWatermark("arrived", wait).groupBy("conv_id")
    return keyed.transformWithState(statefulProcessor=Assembler(wait_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def assembled_batch(turns: DataFrame) -> DataFrame:
    """The same of a table that holds all turns: the first to arrive of those that came twice counts."""
    first = turns.groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), "arrived").alias("m"), F.count(F.lit(1)).alias("times"), F.max("n_turns").alias("n_turns"))
    found = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("x"), F.max("n_turns").alias("expected"))
    return found.select("conv_id", (F.size("x") >= F.col("expected")).alias("complete"), F.size("x").cast("long").alias("n_turns"), F.transform("x", lambda t: t["m"]).alias("messages"))
