"""Numbers as the bytes that other programs keep them in: little-endian packing of columns and arrays, and digests of those bytes.

Numbers and arrays are packed by column functions: integers by shifting their bytes, floating-point numbers by taking sign, exponent and fraction apart
exactly. That is some microseconds a number, so whole rows of arrays are digested from Arrow batches, which hold these bytes already (array_digest).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes, exponent bits and fraction bits of floating-point kinds.
FLOATS = {"float": (4, 8, 23), "double": (8, 11, 52)}
WHOLE = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def _swapped(bits: Column, size: int) -> Column:
    """The hexadecimal digits of the low size bytes of a long, least byte first."""
    if size == 8:  # the two halves apart, as hex() of a whole negative long has 16 digits anyway
        return F.concat(_swapped(bits.bitwiseAND(F.lit(0xFFFFFFFF)), 4), _swapped(F.shiftrightunsigned(bits, 32), 4))
    byte = lambda k: F.shiftleft(F.shiftrightunsigned(bits, 8 * k).bitwiseAND(F.lit(255)), 8 * (size - 1 - k))
    whole = byte(0)
    for k in range(1, size):
        whole = whole.bitwiseOR(byte(k))
    return F.lpad(F.hex(whole), 2 * size, "0")


def bits_of(x: Column, kind: str) -> Column:
    """The bits of a float or double as a long; every value that is no number has the same ones."""
    _, exponents, fraction = FLOATS[kind]
    bias = (1 << (exponents - 1)) - 1
    v = x.cast("double")
    size = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 1.0).otherwise(F.abs(v))
    # Powers of two are exact; the logarithm may be off by one next to one.
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(bias)), F.lit(1 - bias)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(size < power(guess), guess - 1).when((guess < bias) & (size >= power(F.least(guess + 1, F.lit(bias)))), guess + 1).otherwise(guess)
    exponent = F.greatest(exponent, F.lit(1 - bias))
    whole = (size / power(exponent) * float(1 << fraction)).cast("long")
    normal = whole >= (1 << fraction)
    own = F.when(normal, F.shiftleft((exponent + bias).cast("long"), fraction).bitwiseOR(whole - F.lit(1 << fraction))).otherwise(whole)
    top = F.shiftleft(F.lit((1 << exponents) - 1).cast("long"), fraction)
    sign = F.when((v < 0) | x.cast("string").startswith("-"), F.shiftleft(F.lit(1).cast("long"), exponents + fraction)).otherwise(F.lit(0).cast("long"))
    return F.when(F.isnan(v), top.bitwiseOR(F.shiftleft(F.lit(1).cast("long"), fraction - 1))).when(size == 0, sign).when(F.abs(v) == float("inf"), sign.bitwiseOR(top)).otherwise(sign.bitwiseOR(own))


def digits(x: Column, kind: str) -> Column:
    """Hexadecimal digits of a value's bytes, least byte first; kind is boolean, a whole kind, float or double."""
    if kind == "boolean":
        return F.when(x, "01").otherwise("00")
    if kind in FLOATS:
        return _swapped(bits_of(x, kind), FLOATS[kind][0])
    return _swapped(x.cast("long"), WHOLE[kind])


def packed(values: Column, kind: str) -> Column:
    """The bytes of an array of this kind, as numpy's tobytes() gives them; null elements are errors."""
    sound = F.assert_true(~F.exists(values, lambda x: x.isNull()), F.lit("an array with nulls has no bytes")).isNull()
    return F.when(sound, F.unhex(F.array_join(F.transform(values, lambda x: digits(x, kind)), "")))


def digest(*parts: Column) -> Column:
    """SHA-256 of binaries one after another, in hexadecimal digits."""
    return F.sha2(F.concat(*parts), 256)


def _array_bytes(column: pa.Array) -> list[bytes]:
    """The bytes of each array of a column of numbers or booleans."""
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("an array with nulls has no bytes")
    values = flat.to_numpy(zero_copy_only=False)
    values = np.where(np.isnan(values), values.dtype.type(np.nan), values) if values.dtype.kind == "f" else values
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) * values.itemsize
    data = values.astype(values.dtype.newbyteorder("<")).tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(column) else []


def _array_digests(*columns: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(b"".join(parts)).hexdigest() for parts in zip(*map(_array_bytes, columns), strict=True)], pa.string())


def array_digest(arrays: dict[str, str]) -> Column:
    """digest(packed(...), ...) of array columns, given with their kinds."""
    return F.arrow_udf(_array_digests, "string")(*(F.col(c).cast(f"array<{kind}>") for c, kind in arrays.items()))
