"""JSON as it stands against the standard reader, and each offence by its path."""

import json
import random

import pytest
from pyspark.sql import functions as F

from convspan.functions import json_domain

OFFENCES = {
    '{"a":1,"a":2}': "$.a: a key stands twice", '{"a":{"b":[1,{"c":1,"\\u0063":2}]}}': "$.a.b[1].c: a key stands twice", '{"a b":NaN}': '$["a b"]: not a finite number', "[1,-Infinity]": "$[1]: not a finite number", "1e999": "$: not a finite number",
    "": "$: no JSON value", "nul": "$: no JSON value", "[1,]": "$[1]: no JSON value", "[1 2]": "$: a list does not end", '{"a" 1}': "$.a: no colon", '{"a":1': "$: an object does not end", "{a:1}": "$: no string", '"a\nb"': "$: no string", "01": "$: text after the value",
    "{} {}": "$: text after the value", "[" * 300 + "]" * 300: f"{'$' + '[0]' * 201}: too deep", '"\\x"': "$: no string", "+1": "$: no JSON value", "[.5]": "$[0]: no JSON value",
}


def test_offences():
    for text, fault in OFFENCES.items():
        with pytest.raises(json_domain.Offence) as found:
            json_domain.compact(text)
        assert str(found.value) == fault, text


def test_order_and_digits_stay():
    assert json_domain.compact(' { "z" : 1.500 , "a" : [ 1e5 , -0 , 12345678901234567890 , " x\\u00e9 " ] , "m" : { } , "n" : [ ] , "t" : true } ') == '{"z":1.500,"a":[1e5,-0,12345678901234567890," x\\u00e9 "],"m":{},"n":[],"t":true}'


def test_like_the_standard_reader():
    rng = random.Random(1)

    def made(depth):
        kind = rng.randint(0, 7 if depth else 5)
        if kind == 6:
            return [made(depth - 1) for _ in range(rng.randint(0, 4))]
        if kind == 7:
            return {rng.choice("abcdé\n\"") + str(k): made(depth - 1) for k in range(rng.randint(0, 4))}
        return [None, True, rng.randint(-999, 999), rng.random() * 10.0 ** rng.randint(-9, 9), "tab\t\"é😀\\", ""][kind]

    for _ in range(400):
        value = made(4)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))
        assert json.loads(json_domain.compact(text)) == value and len(json_domain.compact(text)) <= len(text)
        broken = text[: rng.randint(0, len(text) - 1)] + rng.choice(("", ",", "}", "x"))
        try:
            json.loads(broken)
        except ValueError:
            with pytest.raises(json_domain.Offence):
                json_domain.compact(broken)


def test_columns(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate([None, ' {"b": 1.0, "a": 2} ', *OFFENCES])], "k int, t string")
    got = [(r.c.value, r.c.fault) for r in table.select("k", json_domain.checked(F.col("t")).alias("c")).orderBy("k").collect()]
    assert got[:2] == [(None, None), ('{"b":1.0,"a":2}', None)] and [f for _, f in got[2:]] == list(OFFENCES.values())
