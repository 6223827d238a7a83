"""JSON values in columns of text, in the styles that identities, people and logs want.

Built-in functions rewrite numbers and lose the order of keys, so the styles are made from the text in tasks, on Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _restyled(**style):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, **style))

    return F.pandas_udf(run, T.StringType())


#: Sorted keys without spaces, for hashes; keys as they stand with spaces, for templates; indented, for people.
_canonical, _spaced, _pretty = _restyled(sort_keys=True, separators=(",", ":")), _restyled(), _restyled(indent=2)


def canonical(value: Column) -> Column:
    return _canonical(value)


def spaced(value: Column) -> Column:
    return _spaced(value)


def pretty(value: Column) -> Column:
    return _pretty(value)


def identity(prefix: str, value: Column) -> Column:
    """Hash of a JSON value that does not depend on the order of keys or on spaces."""
    return F.sha2(F.concat(F.lit(prefix + "\0"), canonical(value)), 256)


def lines(events: DataFrame) -> DataFrame:
    """value: each row as a JSON line, null fields kept."""
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(events: DataFrame, path: str) -> None:
    """The rows as files of JSON lines in a new folder."""
    lines(events).write.mode("errorifexists").text(path)
