"""Document fingerprints by consistent weighted sampling, with built-in column functions only.

A document is the multiset of its words. For sample k every word has three random numbers that depend on the word and k alone: r and c
from a gamma distribution of shape 2, b uniform. A word of weight w is seen as the largest y <= w on the grid exp(r * (n - b)), n
whole, and the word with the least c / (y * exp(r)) is the sample. Two documents have the same sample k with the probability of
their generalised Jaccard similarity, sum of the lesser weights over sum of the greater ones (improved consistent weighted sampling).
The least value itself stands for the sample, as it is made from the word and its n alone.

Neighbours in doc_id order are found without a global sort: doc_ids fall into cells, ordered ranges with about as many rows each (quantiles,
then equal widths within them), and each cell also gets the first row of the next one as a guest. One shuffle by cell then serves the
edited texts, the words' counts, the samples and the comparison with the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspan.llm.common import SPACES, partitions, text_or_empty

#: Samples in a fingerprint; the standard error of a likeness p is sqrt(p * (1 - p) / SAMPLES).
SAMPLES = 40
#: Hexadecimal digits of a sample's hash in the fingerprint.
HEX = 4
#: Quantiles of doc_id, at most; cells are these, cut in equal widths.
QUANTILES = 256
#: Cells for each shuffle partition.
CELLS = 8
LAST = (1 << 63) - 1
#: From here on rows without a doc_id have their places.
FIRST_NULL = 1 << 62


def _cell(docs: DataFrame, cells: int) -> Column:
    """A number that grows with the column at, for about equally many rows each."""
    n = max(1, min(QUANTILES, cells // CELLS))
    bounds = sorted(set(docs.approxQuantile("at", [i / n for i in range(n + 1)], 0.25 / n))) or [0.0]
    if len(bounds) < 2:
        return F.lit(0).cast("long")
    inner, wide = F.array(*map(F.lit, bounds[1:-1])) if len(bounds) > 2 else F.array().cast("array<double>"), -(-cells // n)
    quantile = F.size(F.filter(inner, lambda x: x <= F.col("at"))).cast("int")
    lows = F.get(F.array(*map(F.lit, bounds[:-1])), quantile)
    widths = F.get(F.array(*(F.lit(max(b - a, 1.0)) for a, b in zip(bounds, bounds[1:], strict=False))), quantile)
    within = F.least(F.greatest(F.floor((F.col("at") - lows) / widths * wide), F.lit(0)), F.lit(wide - 1))
    return (quantile * F.lit(wide) + within).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """cell, place, guest, doc_id, text, next_text of every row; a guest is a copy of the next cell's first row.

    Rows are in the order of doc_id, then text; those without a doc_id come last, in the order of a hash of their texts, so that many
    of them fall into many cells. The row after the last one is the first.
    """
    spark = docs.sparkSession
    last = F.lit(FIRST_NULL) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("at", F.coalesce(F.col("doc_id").cast("long"), last))
    rows = rows.withColumn("cell", _cell(rows, CELLS * partitions(spark)))
    # One row per cell: at most 2 * CELLS * partitions and 16 bytes each, so the window over all and the broadcast are small.
    firsts = rows.groupBy("cell").agg(F.min("at").alias("at"))
    order = Window.orderBy("cell")
    firsts = firsts.withColumn("to", F.coalesce(F.lag("cell").over(order), F.max("cell").over(Window.partitionBy()))).drop("cell")
    guests = rows.drop("cell").join(F.broadcast(firsts), "at").groupBy("to").agg(F.min(F.struct("text", "doc_id")).alias("first"))
    guests = guests.select("first.doc_id", "first.text", F.lit(LAST).alias("at"), F.col("to").alias("cell"), F.lit(True).alias("guest"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition(2 * partitions(spark), "cell")
    order = Window.partitionBy("cell").orderBy("guest", "at", "text")
    return every.select("cell", F.row_number().over(order).alias("place"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def _sample(word: str, weight: Column, k: int) -> Column:
    """Logarithm of c / (y * exp(r)) for a word's hash and the logarithm of its weight; null without weight."""
    x, y = F.xxhash64(word, F.lit(k)), F.xxhash64(word, F.lit(-1 - k))
    low = lambda bits, n: (bits.bitwiseAND(F.lit((1 << n) - 1)) + 0.5)
    r = -F.log((F.shiftrightunsigned(x, 42) + 0.5) * low(F.shiftrightunsigned(x, 21), 21) * 2.0**-43)
    b = low(x, 21) * 2.0**-21
    c = -F.log((F.shiftrightunsigned(y, 32) + 0.5) * low(y, 32) * 2.0**-64)
    return F.log(c) - r * (F.floor(weight / r + b) - b + 1.0)


def _samples(weights: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Per group: SAMPLES least values as an array of 2-byte hashes, for each (weight column, name)."""
    logs = weights.withColumns({w: F.log(w) for w in names})
    least = logs.groupBy(*keys).agg(*[F.min(_sample("word", F.col(w), k)).alias(f"{w}_{k}") for w in names for k in range(SAMPLES)])
    digits = lambda c: F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(c), F.lit(16**HEX)))), HEX, "0")
    return least.select(*keys, *[F.when(F.col(f"{w}_0").isNull(), "").otherwise(F.concat(*[digits(f"{w}_{k}") for k in range(SAMPLES)])).alias(name) for w, name in names.items()])


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprints; 1 for two without words, 0 for one."""
    equal = [(F.substring(a, k * HEX + 1, HEX) == F.substring(b, k * HEX + 1, HEX)).cast("int") for k in range(SAMPLES)]
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(sum(equal[1:], equal[0]) / F.lit(float(SAMPLES)))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs(doc_id, text).

    The edited text is the text with its last floor(n_chars / 2) characters replaced by the first as many of the next row's. A text
    without words (null, empty, white space) has the empty fingerprint. Equal texts have equal fingerprints, repeated rows included;
    the next of a repeated row is its repetition. Rows with a null doc_id come after all others, in the order of a hash of their
    texts. Other columns are ignored; an empty table gives an empty one.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = with_next(docs).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    # Both uses of the pairs read the same columns, so that the shuffle of the texts is run once. The aggregates are few enough for
    # generated code (spark.sql.codegen.maxFields).
    words = pairs.select("cell", "place", "doc_id", F.posexplode(F.array("text", "edited")).alias("side", "one"))
    words = words.select("cell", "place", "doc_id", "side", F.explode(F.split("one", f"{SPACES}+")).alias("word")).select("cell", "place", "doc_id", "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("word"))
    counts = words.groupBy("cell", "place", "doc_id", "word").agg(F.sum(1 - F.col("side")).alias("own"), F.sum("side").alias("changed"))
    found = _samples(counts.withColumns({w: F.when(F.col("word").isNotNull(), F.col(w)) for w in ("own", "changed")}), ["cell", "place", "doc_id"], {"own": "fingerprint", "changed": "edited_fingerprint"})
    found = found.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("cell").orderBy("place"))).drop("doc_id")
    facts = pairs.where(~F.col("guest")).select("cell", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(found, ["cell", "place"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next").alias("near_next"),
    )
