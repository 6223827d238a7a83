"""Low-rank adapters on long tables: names of parameters, first values, audits, the layer itself and flat names.

shapes are rows (path, n_in, n_out) of the kernels that get adapters; adapters are rows (path, part, i, j, value), part a or b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspan.operators.params import matmul, small

IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


def path_name(parts: Column) -> Column:
    """The name of a parameter from the parts of its path, numbers in brackets; null if a part is neither a number nor an identifier."""
    number = lambda p: p.rlike("^[0-9]+$")
    shown = F.transform(parts, lambda p, i: F.when(number(p), F.concat(F.lit("["), p, F.lit("]"))).when(i == 0, p).otherwise(F.concat(F.lit("."), p)))
    sound = (F.size(parts) > 0) & F.forall(parts, lambda p: number(p) | p.rlike(IDENTIFIER))
    return F.when(sound, F.array_join(shown, ""))


def init(shapes: DataFrame, rank: int, seed: int) -> DataFrame:
    """First adapters: a uniform within 1 / sqrt(n_in) by a hash of seed and place, b zero. A rank above a dimension is an error."""
    wide = F.assert_true(F.least("n_in", "n_out") >= rank, F.concat(F.lit("the rank exceeds a dimension of "), "path")).isNull()
    a = shapes.where(wide).select("path", "n_in", F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(rank - 1))).alias("j"))
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "path", F.col("i").cast("string"), F.col("j").cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    a = a.select("path", F.lit("a").alias("part"), "i", "j", ((draw * 2 - 1) / F.sqrt("n_in")).alias("value"))
    b = shapes.select("path", F.lit("b").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(rank - 1))).alias("i"), "n_out").select("path", "part", "i", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("j"), F.lit(0.0).alias("value"))
    return a.unionByName(b)


def faults(shapes: DataFrame, adapters: DataFrame, rank: int) -> DataFrame:
    """path, part, fault of adapters that are missing, unexpected, or of another shape than their kernel asks for."""
    expected = shapes.select("path", F.explode(F.array(F.struct(F.lit("a").alias("part"), F.col("n_in").alias("rows"), F.lit(rank).alias("columns")), F.struct(F.lit("b").alias("part"), F.lit(rank).alias("rows"), F.col("n_out").alias("columns")))).alias("x")).select("path", "x.*")
    found = adapters.groupBy("path", "part").agg((F.max("i") + 1).alias("own_rows"), (F.max("j") + 1).alias("own_columns"), F.count(F.lit(1)).alias("values"))
    both = expected.join(found, ["path", "part"], "full_outer")
    shape = (F.col("rows") != F.col("own_rows")) | (F.col("columns") != F.col("own_columns")) | (F.col("values") != F.col("rows") * F.col("columns"))
    fault = F.when(F.col("own_rows").isNull(), "missing").when(F.col("rows").isNull(), "unexpected").when(shape, "another shape")
    return both.select("path", "part", fault.alias("fault")).where("fault is not null")


def linear(x: DataFrame, w: DataFrame, a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """path, i, j, value of x w + scale (x a) b, all matrices as rows (path, i, j, value); w, a and b are broadcast where they are small."""
    update = matmul(matmul(x, small(a)), small(b)).withColumnRenamed("value", "update")
    return matmul(x, small(w)).join(update, ["path", "i", "j"], "left").select("path", "i", "j", (F.col("value") + F.coalesce(F.col("update"), F.lit(0.0)) * scale).alias("value"))


def flat(adapters: DataFrame) -> DataFrame:
    """Adapters under one name for each tensor: name, i, j, value."""
    return adapters.select(F.concat("path", F.lit(".lora_"), "part").alias("name"), "i", "j", "value")


def unflat(tensors: DataFrame) -> DataFrame:
    """Adapters from flat names; a name that is none is an error."""
    sound = F.assert_true(F.col("name").rlike(r"\.lora_[ab]$"), F.concat(F.lit("no adapter: "), "name")).isNull()
    return tensors.where(sound).select(F.regexp_extract("name", r"^(.*)\.lora_[ab]$", 1).alias("path"), F.right("name", F.lit(1)).alias("part"), "i", "j", "value")
