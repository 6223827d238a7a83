"""Mixing sources to target weights by entropy balancing.

Of all mixes that meet each source's token constraint, the one nearest to the corpus (least relative entropy, a document weighing as
much as its words) gives document d of source s the rate exp(lambda_s): the corpus, exponentially tilted. The dual in lambda is convex
and its gradient, size_s * exp(lambda_s) - target_s, needs only token sums, which one distributed aggregation over the documents
yields; Newton's iterations then run beside each other on the table of sources, as a column expression.

Rates become copies: every document is taken floor(rate) times, and the words still missing in a source come from one more copy of
its documents in the order of a hash of their ids. The running sums for that are taken per (source, slice of the hash range) and then
over the slices of a source, so that no task holds a source. The document at the limit gives only the words that are missing, so each
source's words meet its target to the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspan.llm.common import WORDS, checkpointed

#: Hexadecimal digits of the id's hash that name a slice; 16 ** DIGITS slices cut a source's running sum.
DIGITS = 3
#: Newton's iterations; from 0 each lowers a too large lambda by up to 1 and then doubles the right digits.
ITERATIONS = 48
#: Decimal digits of the rates that are kept, so that a rate of exactly 3 is 3.
RATE_DIGITS = 9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source: source, source_size, target, rate.

    Sources in code point order, null last, take the weights in turn and share all words by them; a target stops at cap times its
    source's size and the excess is shared again by weight until none is above. That is the water level L with
    sum(min(cap * size, weight * L)) = all words; sources reach their cap in order of cap * size / weight. One row per source, so the
    running sums over all sources are small. A source without words has target and rate 0.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1).cast("long"))
    per = per.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    per = per.withColumn("words", F.sum("source_size").over(every))
    per = per.withColumn("left", F.col("words") - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(after))
    per = per.withColumn("full", F.col("most") * F.col("weights") <= F.col("weight") * F.col("left"))
    per = per.withColumn("left", F.max(F.when(~F.col("full"), F.col("left"))).over(every)).withColumn("weights", F.max(F.when(~F.col("full"), F.col("weights"))).over(every))
    per = per.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("left") / F.col("weights")))
    step = lambda tilt, _: tilt - 1 + F.try_divide(F.col("target"), F.col("source_size")) * F.exp(-tilt)
    tilt = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), F.lit(0.0), step)
    rate = F.when(F.col("target") > 0, F.round(F.exp(tilt), RATE_DIGITS)).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", F.least(rate, F.lit(float(cap))).alias("rate"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, taken, copies of every row of docs(doc_id, text, source).

    size is the number of words, taken the words of the row that the mix takes (repeats counted, at most cap times size), copies the
    nearest number of whole copies. A null or empty text has size 0 and is taken 0 times; a null source is a source of its own,
    after all others; a row with a null doc_id has the place of its text's hash; repeated rows are rows of their own; an empty table gives an empty one.
    Ties in the hash order fall to doc_id, then size, then keys, columns of docs that the rows bring along, after the others.
    Other columns are ignored. Runs on the same rows agree.
    """
    count = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    sizes = docs.select("doc_id", "source", count.alias("size"), order.alias("order"), *keys)
    sizes = checkpointed(sizes.withColumn("slice", F.substring("order", 1, DIGITS)))
    # A key that a null source has too, for joins.
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    targets = source_targets(sizes, weights, cap).withColumn("named", named).drop("source")
    whole = F.floor("rate")
    missing = F.least(F.greatest(F.round("target").cast("long") - whole * F.col("source_size"), F.lit(0)), F.col("source_size"))
    earlier = Window.partitionBy("named").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sizes.withColumn("named", named).groupBy("named", "slice").agg(F.sum("size").alias("slice_size"))
    slices = slices.withColumn("earlier", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    slices = slices.join(targets, "named").withColumn("missing", missing)
    here = Window.partitionBy("named", "slice").orderBy("order", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("named", named).join(slices, ["named", "slice"])
    rows = rows.withColumn("before", F.col("earlier") + F.coalesce(F.sum("size").over(here), F.lit(0)))
    more = F.least(F.greatest(F.col("missing") - F.col("before"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("more", more)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "rate",
        (whole * F.col("size") + F.col("more")).alias("taken"),
        F.when(F.col("size") > 0, whole + (F.col("more") * 2 > F.col("size")).cast("long")).otherwise(F.lit(0)).alias("copies"),
        *keys,
    )


#: The same mix in DuckDB, with the closed form target / source_size in place of Newton's iterations.
MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS ord FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM per),
level AS (SELECT *, source_size * 3 AS most, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM weighed),
capped AS (SELECT *, most * weights <= weight * rest AS filled FROM level),
targets AS (SELECT source, source_size, CASE WHEN filled THEN CAST(most AS DOUBLE) ELSE CAST(weight * max(rest) FILTER (NOT filled) OVER () AS DOUBLE) / CAST(max(weights) FILTER (NOT filled) OVER () AS DOUBLE) END AS target FROM capped),
rates AS (SELECT *, CASE WHEN target > 0 THEN least(round(target / source_size, 9), 3) ELSE 0 END AS rate FROM targets),
runs AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM sizes s)
SELECT doc_id, size, source_size, target,
    CAST(floor(rate) * size + least(greatest(least(greatest(round(target) - floor(rate) * source_size, 0), source_size) - earlier, 0), size) AS BIGINT) AS taken
FROM runs JOIN rates ON runs.source IS NOT DISTINCT FROM rates.source
"""
