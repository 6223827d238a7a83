"""Table functions for SQL by which users bring their own adapters, renderers and encoders.

    SELECT * FROM adapt_rows(TABLE(raw), adapter => 'my.module:function')
    SELECT * FROM render_rows(TABLE(messages) PARTITION BY sample_id ORDER BY message_index, renderer => 'my.module:function')
    SELECT * FROM encode_texts(TABLE(docs), encoder => '/path/of/tokenizer.json')

What a function returns depends on its table: its columns pass through, so it is planned for each call. Functions are named by module and name
and imported where they run; files are read once, on the driver, and travel with the plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import import_module
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from convspan.operators.encoders import BytePairs


def _function(name: object) -> Callable:
    """A function named module:name."""
    module, _, attribute = str(name).partition(":")
    found = getattr(import_module(module), attribute, None) if attribute else None
    if not callable(found):
        raise ValueError(f"{name} names no function as module:function")
    return found


def _columns(table: AnalyzeArgument, *needed: str) -> list[T.StructField]:
    if not table.isTable:
        raise ValueError("the first argument is a table")
    if missing := set(needed) - set(table.dataType.names):
        raise ValueError(f"the table lacks {sorted(missing)}")
    return list(table.dataType.fields)


def _fields(*given: tuple[str, T.DataType]) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in given]


@dataclass
class Planned(AnalyzeResult):
    """A call as planned: the columns that pass through, the function's name or the file."""

    kept: list[str] = field(default_factory=list)
    name: str = ""
    raw: bytes = b""


class AdaptRows:
    """function(row) gives (role, text) of each message of a row, or raises ValueError with the reason why it has none."""

    def __init__(self, planned: Planned):
        self.kept, self.adapt = planned.kept, _function(planned.name)

    @staticmethod
    def analyze(table: AnalyzeArgument, adapter: AnalyzeArgument) -> Planned:
        _function(adapter.value)
        columns = _columns(table)
        more = _fields(("message_index", T.IntegerType()), ("role", T.StringType()), ("message", T.StringType()), ("reason", T.StringType()))
        return Planned(T.StructType(columns + more), kept=[c.name for c in columns], name=adapter.value)

    def eval(self, row: Row, adapter: str) -> Iterator[tuple]:
        own = tuple(row[c] for c in self.kept)
        try:
            found = [(*own, k, role, text, None) for k, (role, text) in enumerate(self.adapt(row))]
        except ValueError as reason:
            found = [(*own, None, None, None, str(reason)[:240])]
        yield from found


class RenderRows:
    """function(messages) gives (span_class, role, message_index, text, default_weight) of each span of a sample's rows."""

    def __init__(self, planned: Planned):
        self.render, self.rows = _function(planned.name), []

    @staticmethod
    def analyze(table: AnalyzeArgument, renderer: AnalyzeArgument) -> Planned:
        _function(renderer.value)
        key = next(c for c in _columns(table, "sample_id", "message_index", "role", "text") if c.name == "sample_id")
        more = _fields(("span_index", T.IntegerType()), ("span_class", T.StringType()), ("role", T.StringType()), ("message_index", T.IntegerType()), ("text", T.StringType()), ("default_weight", T.DoubleType()))
        return Planned(T.StructType([key, *more]), name=renderer.value)

    def eval(self, row: Row, renderer: str) -> None:
        self.rows.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            for k, (kind, role, at, text, weight) in enumerate(x for x in self.render(self.rows) if x[3]):
                yield self.rows[0].sample_id, k, kind, role, at, text, float(weight)


class EncodeTexts:
    """Tokens of the column text by a byte-level tokenizer file."""

    def __init__(self, planned: Planned):
        self.kept, self.encoder = planned.kept, BytePairs(json.loads(planned.raw))

    @staticmethod
    def analyze(table: AnalyzeArgument, encoder: AnalyzeArgument) -> Planned:
        columns = [c for c in _columns(table, "text") if c.name != "text"]
        raw = Path(str(encoder.value)).read_bytes()
        BytePairs(json.loads(raw))  # a file that is not read fails while planning
        more = _fields(("pos", T.IntegerType()), ("token", T.StringType()), ("token_id", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()))
        return Planned(T.StructType(columns + more), kept=[c.name for c in columns], raw=raw)

    def eval(self, row: Row, encoder: str) -> Iterator[tuple]:
        own = tuple(row[c] for c in self.kept)
        ids, starts, ends = self.encoder.encode(row["text"] or "")
        for k, (token, start, end) in enumerate(zip(ids, starts, ends, strict=True)):
            yield (*own, k, self.encoder.names[token], token, start, end)


FUNCTIONS = {"adapt_rows": AdaptRows, "render_rows": RenderRows, "encode_texts": EncodeTexts}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, kind in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(kind))


def transcript(rows: list[Row]) -> Iterator[tuple]:
    """A renderer: every message as a line with its role."""
    for row in rows:
        yield "role_header", row.role, row.message_index, f"{row.role}: ", 0.0
        yield "content", row.role, row.message_index, row.text, 1.0 if row.role == "assistant" else 0.0
        yield "turn_end", row.role, row.message_index, "\n", 0.0


def first_exchange(row: Row) -> list[tuple[str, str]]:
    """An adapter: the first question of a row of messages and the answer right after it."""
    for one, two in zip(row.messages, row.messages[1:], strict=False):
        if one.role == "user" and two.role == "assistant":
            return [("user", one.content), ("assistant", two.content)]
    raise ValueError("no question with an answer")
