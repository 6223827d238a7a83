"""JSON text as it stands: checked against the JSON domain, with the order of keys and the digits of numbers kept.

Readers that build values lose both, take NaN, and let the last of two equal keys win. This one walks the text once and answers with the text
without its white space, or with the path and kind of the first offence. It runs on Arrow batches in tasks.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
WORD = re.compile(r"-?[A-Za-z]+")
SPACE = re.compile(r"[ \t\n\r]*")
PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
WORDS = ("true", "false", "null")
#: Objects and lists within each other, at most.
DEPTH = 200


class Offence(ValueError):
    """What is wrong, and where."""


def compact(text: str) -> str:
    """The text without white space between tokens; an Offence if it is no JSON value."""
    out: list[str] = []

    def skip(at: int) -> int:
        return SPACE.match(text, at).end()

    def string(at: int, path: str) -> tuple[str, int]:
        found = STRING.match(text, at)
        if not found:
            raise Offence(f"{path}: no string")
        return found[0], found.end()

    def value(at: int, path: str, depth: int) -> int:
        at = skip(at)
        first = text[at : at + 1]
        if depth > DEPTH:
            raise Offence(f"{path}: too deep")
        if first in ("{", "["):
            return members(at + 1, path, depth) if first == "{" else items(at + 1, path, depth)
        if first == '"':
            token, at = string(at, path)
            out.append(token)
            return at
        if (word := WORD.match(text, at)) is not None:
            if word[0].lstrip("-") in ("NaN", "Infinity"):
                raise Offence(f"{path}: not a finite number")
            if word[0] not in WORDS:
                raise Offence(f"{path}: no JSON value")
            out.append(word[0])
            return word.end()
        number = NUMBER.match(text, at)
        if not number:
            raise Offence(f"{path}: no JSON value")
        if abs(float(number[0])) == float("inf"):
            raise Offence(f"{path}: not a finite number")
        out.append(number[0])
        return number.end()

    def members(at: int, path: str, depth: int) -> int:
        out.append("{")
        seen: set[str] = set()
        at = skip(at)
        if text[at : at + 1] == "}":
            out.append("}")
            return at + 1
        while True:
            token, at = string(skip(at), path)
            key = json.loads(token)
            below = f"{path}.{key}" if PLAIN.fullmatch(key) else f"{path}[{json.dumps(key, ensure_ascii=False)}]"
            if key in seen:
                raise Offence(f"{below}: a key stands twice")
            seen.add(key)
            at = skip(at)
            if text[at : at + 1] != ":":
                raise Offence(f"{below}: no colon")
            out.append(token + ":")
            at = skip(value(at + 1, below, depth + 1))
            mark = text[at : at + 1]
            if mark not in (",", "}") or not mark:
                raise Offence(f"{path}: an object does not end")
            out.append(mark)
            at += 1
            if mark == "}":
                return at

    def items(at: int, path: str, depth: int) -> int:
        out.append("[")
        at = skip(at)
        if text[at : at + 1] == "]":
            out.append("]")
            return at + 1
        k = 0
        while True:
            at = skip(value(at, f"{path}[{k}]", depth + 1))
            mark = text[at : at + 1]
            if mark not in (",", "]") or not mark:
                raise Offence(f"{path}: a list does not end")
            out.append(mark)
            at, k = at + 1, k + 1
            if mark == "]":
                return at

    if skip(value(0, "$", 0)) != len(text):
        raise Offence("$: text after the value")
    return "".join(out)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("fault", T.StringType())]))
def _checked(texts: pd.Series) -> pd.DataFrame:
    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return compact(text), None
        except Offence as fault:
            return None, str(fault)

    return pd.DataFrame([one(x) for x in texts], columns=["value", "fault"], dtype=object)


def checked(text: Column) -> Column:
    """value and fault of JSON text: the text without white space, or the first offence; both null for null."""
    return _checked(text)
