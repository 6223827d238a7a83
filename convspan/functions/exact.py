"""Sums of doubles that are exact until the one rounding at the end, so they are bitwise alike under any partitioning and order.

A double is a whole number of 53 bits times a power of two. Powers are put into bins 32 apart, and in a bin numbers are added as decimals, in which
nothing is rounded: partial sums before the shuffle, as for any sum. A group has at most 66 bins; their whole numbers are put
together and divided once, in whole numbers of any size, which rounds to nearest, ties to even.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspan.functions import packing

#: Bits between bins, and the power of the least bit of a double.
BIN, LEAST = 32, 1074


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rounded(bins: pd.Series, odd: pd.Series) -> pd.Series:
    """Sums of the columns as text, which tells NaN from null, from (column, bin, whole number) and, as text, the sum of what is not finite by column."""

    def one(parts: list[dict], rest: list[str | None]) -> list[str | None]:
        totals: dict[int, int] = {}
        for p in parts:
            totals[p["column"]] = totals.get(p["column"], 0) + (int(p["whole"]) << (BIN * p["bin"]))
        found = []
        for k, other in enumerate(rest):
            if other is not None:
                found.append(other)
            elif k not in totals:
                found.append(None)
            else:
                try:
                    found.append(repr(totals[k] / (1 << LEAST)))
                except OverflowError:
                    found.append("Infinity" if totals[k] > 0 else "-Infinity")
        return found

    return pd.Series([one(list(b), list(o)) for b, o in zip(bins, odd, strict=True)])


def exact_sums(rows: DataFrame, columns: dict[str, Column], keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """keys and the exact sum of each column of doubles, under its name: null values are passed over, a group without others has null.

    Infinities and NaN make the sum what they make any sum. Without keys there is one row.
    """
    names = list(columns)
    values = F.array(*[F.struct(F.lit(k).alias("column"), c.cast("double").alias("x")) for k, c in enumerate(columns.values())])
    long = rows.select(*keys, F.explode(values).alias("v")).select(*keys, F.col("v.column").alias("column"), F.col("v.x").alias("x"))
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    bits = packing.bits_of(F.when(finite, F.col("x")).otherwise(0.0), "double")
    long = long.withColumns({"finite": finite, "bits": bits})
    exponent = F.shiftrightunsigned("bits", 52).bitwiseAND(F.lit(2047))
    fraction = F.col("bits").bitwiseAND(F.lit((1 << 52) - 1)) + F.when(exponent > 0, F.lit(1 << 52)).otherwise(F.lit(0))
    place = F.greatest(exponent, F.lit(1)) - 1  # the power of the least bit, counted from that of the least double
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), (place % BIN).cast("int")).cast("decimal(10,0)")
    whole = fraction.cast("decimal(17,0)") * scale * F.when(F.col("x") < 0, -1).otherwise(1).cast("decimal(1,0)")
    long = long.select(*keys, "column", "finite", "x", F.when(F.col("finite"), F.floor(place / BIN).cast("int")).alias("bin"), F.when(F.col("finite"), whole.cast("decimal(28,0)")).alias("whole"))
    binned = long.groupBy(*keys, "column", "bin").agg(F.sum("whole").alias("whole"), F.sum(F.when(~F.col("finite") & F.col("x").isNotNull(), F.col("x"))).alias("odd"))
    of = lambda k: F.sum(F.when(F.col("column") == k, F.col("odd")))
    kept = F.collect_list(F.when(F.col("whole").isNotNull(), F.struct("column", "bin", F.col("whole").cast("string").alias("whole"))))
    groups = binned.groupBy(*keys).agg(kept.alias("bins"), F.array(*[of(k).cast("string") for k in range(len(names))]).alias("odd"))
    found = groups.withColumn("sums", _rounded("bins", "odd"))
    return found.select(*keys, *[F.get("sums", F.lit(k)).cast("double").alias(name) for k, name in enumerate(names)])
