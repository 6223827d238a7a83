"""Packed bytes against numpy's."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspan.functions import packing


def floats(kind, rng):
    size, letter = (4, "f") if kind == "float" else (8, "d")
    made = [struct.unpack(f"<{letter}", rng.randbytes(size))[0] for _ in range(1500)]
    edges = [0.0, -0.0, 1.0, -1.0, 0.5, math.inf, -math.inf, math.nan]
    info = np.finfo(np.float32 if kind == "float" else np.float64)
    edges += [float(v) for v in (info.max, info.tiny, info.smallest_subnormal, info.smallest_subnormal * 3, info.tiny - info.smallest_subnormal, -info.max)]
    edges += [float(np.nextafter(info.dtype.type(2.0**e), info.dtype.type(d))) for e in range(-20, 21) for d in (-math.inf, math.inf)] + [2.0**e for e in range(-126, 127, 9)]
    return [v for v in made if not math.isnan(v)] + edges


@pytest.mark.parametrize("kind,numpy_kind", [("int", "<i4"), ("bigint", "<i8"), ("smallint", "<i2"), ("boolean", "?"), ("float", "<f4"), ("double", "<f8")])
def test_bytes_like_numpy(spark, kind, numpy_kind):
    rng = random.Random(kind)
    if kind in packing.FLOATS:
        values = floats(kind, rng)
    elif kind == "boolean":
        values = [rng.random() < 0.5 for _ in range(300)]
    else:
        top = 1 << (8 * packing.WHOLE[kind] - 1)
        values = [0, 1, -1, top - 1, -top] + [rng.randrange(-top, top) for _ in range(500)]
    table = spark.createDataFrame([(values,), ([],)], f"v array<{kind}>")
    got = [(list(r.v), bytes(r.b), r.d) for r in table.select("v", packing.packed(F.col("v"), kind).alias("b"), packing.digest(packing.packed(F.col("v"), kind)).alias("d")).collect()]
    for found, data, digest in got:
        assert data == np.array(found, numpy_kind).tobytes() and digest == hashlib.sha256(data).hexdigest()
    with pytest.raises(Exception, match="nulls"):
        spark.createDataFrame([([None],)], f"v array<{kind}>").select(packing.packed(F.col("v"), kind)).collect()


def test_digests_of_rows_are_those_of_packed_columns(spark):
    numbers = floats("float", random.Random(3))
    rows = [([k, -k, 1 << 30][: k % 4], [k % 2 == 0, True][: k % 3], numbers[7 * k : 7 * k + k % 5]) for k in range(len(numbers) // 7)] + [([], [], numbers)]
    table = spark.createDataFrame(rows, "a array<int>, b array<boolean>, c array<float>").repartition(3)
    kinds = {"a": "int", "b": "boolean", "c": "float"}
    found = table.select(packing.array_digest(kinds).alias("rows"), packing.digest(*(packing.packed(F.col(c), kind) for c, kind in kinds.items())).alias("columns"))
    assert found.count() == len(rows) and found.where("rows is null or rows <> columns").count() == 0
    for bad in ([None], None):
        with pytest.raises(Exception, match="nulls"):
            spark.createDataFrame([(bad,)], "a array<int>").select(packing.array_digest({"a": "int"})).collect()
