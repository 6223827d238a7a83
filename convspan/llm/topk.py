"""Exact top-k search by Hamming distance with incremental multi-index hashing.

A vector's code is the signs of its numbers, cut into segments of about as many bits as the logarithm of the number of different codes,
so that a segment's value names few codes. The index holds each code under each of its segments' values. In round r every query that
is not settled looks up, in each segment, the values that differ from its own in exactly r bits. After round r every code at a distance
below segments * (r + 1) has been met, as one of its segments differs in r bits at most; a query is settled once its kth verified
distance is below that. Only the others go on to the next round, and what is farther than the kth best so far is dropped where it is met.

Equal codes are one entry of the index, with as many of their least ids as can be asked for, and one query, so that a vector that a
third of all rows hold is searched once. A pair of codes is counted in the round and segment that find it first, so nothing is
told apart by a shuffle. Probes and index meet by one join key; a small index is broadcast, so that only answers are shuffled.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspan.llm.common import checkpointed, partitions

#: Bits of a segment, at most: the values at one distance are a row of up to C(22, 11) longs.
MOST_BITS = 22
#: Rows of the index, about 100 bytes each, up to which it is broadcast.
BROADCAST_ROWS = 400_000


def _segments(width: int, bits: int) -> Column:
    """The signs of the column embedding as an array of longs of `bits` bits each; missing numbers and nulls count as not positive."""
    sign = lambda at, i: F.when(F.coalesce(F.get("embedding", at), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    one = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc + sign(s * bits + i, i))
    return F.transform(F.sequence(F.lit(0), F.lit(-(-width // bits) - 1)), one)


def _masks(bits: int, radius: int) -> list[int]:
    """All numbers of `bits` bits of which `radius` are set."""
    return [sum(1 << i for i in c) for c in combinations(range(bits), radius)]


def _best(rows: DataFrame, k: int) -> DataFrame:
    """Of rows(code, distance, vec_id) the k best of each code."""
    place = F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search_codes(queries: DataFrame, codes: DataFrame, bits: int, segments: int, k: int) -> DataFrame:
    """code, distance, vec_id: the k nearest ids of codes(code, ids) for each row of queries(code), nearest first, ties by id.

    A code is an array of so many segments of so many bits, and different on every row of either table; ids are its least k ids.
    """
    spark = codes.sparkSession
    at = lambda s: F.lit(s << MOST_BITS)
    index = codes.select(F.posexplode("code").alias("segment", "value"), F.col("code").alias("other"), "ids")
    index = index.select((F.call_function("shiftleft", F.col("segment").cast("long"), F.lit(MOST_BITS)) + F.col("value")).alias("key"), "other", "ids")
    index = F.broadcast(index) if codes.count() * segments <= BROADCAST_ROWS else checkpointed(index)
    best, unsettled = None, checkpointed(queries.select("code", F.lit(None).cast("long").alias("bound")))
    for radius in range(bits + 1):
        masks = spark.createDataFrame([(radius, _masks(bits, radius))], "radius int, masks array<long>")
        asked = unsettled.repartition(partitions(spark), "code").withColumn("radius", F.lit(radius)).join(F.broadcast(masks), "radius")
        probes = asked.select("code", "bound", F.posexplode("code").alias("segment", "value"), "masks").select("code", "bound", "segment", "value", F.explode("masks").alias("mask"))
        probes = probes.select("code", "bound", "segment", (F.call_function("shiftleft", F.col("segment").cast("long"), F.lit(MOST_BITS)) + F.col("value").bitwiseXOR(F.col("mask"))).alias("key"))
        apart = [F.bit_count(F.col("code")[s].bitwiseXOR(F.col("other")[s])) for s in range(segments)]
        met = probes.join(index, "key").withColumn("distance", sum(apart[1:], apart[0]).cast("long"))
        met = met.where(F.col("bound").isNull() | (F.col("distance") <= F.col("bound")))
        # Found by no earlier round, and by no segment before this one.
        first = [F.when(F.col("segment") == s, ~F.array_contains(F.array(*[x <= radius for x in apart[:s]], F.lit(False)), True)) for s in range(segments)]
        nowhere_closer = F.least(*apart, F.lit(bits)) == radius
        met = met.where(nowhere_closer & F.coalesce(*first)).select("code", "distance", F.explode("ids").alias("vec_id"))
        best = checkpointed(_best(met if best is None else best.unionByName(met), k))
        reached = segments * (radius + 1) - 1
        state = best.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        unsettled = unsettled.drop("bound").join(state, "code", "left").withColumn("bound", F.when(F.col("n") == k, F.col("far")))
        unsettled = checkpointed(unsettled.where(F.col("bound").isNull() | (F.col("bound") > reached)).select("code", "bound"))
        if unsettled.isEmpty():
            break
    return best


def top_k(vectors: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest other rows of each row of vectors(vec_id, embedding) whose id is divisible by every.

    Codes are as wide as the longest embedding; numbers that a shorter one lacks, nulls and zeros count as not positive, NaN as positive.
    Ties go to the least id; fewer than k other rows give fewer answers. Rows with a null id or embedding are neither queries nor
    answers; of rows of one id that with the least code counts, so repeated rows count once; other columns are ignored; an empty table
    gives an empty one.
    """
    known = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>"))
    n, width = known.agg(F.approx_count_distinct("id"), F.max(F.size("embedding"))).first()
    width = max(width or 0, 1)
    segments = -(-width // min(MOST_BITS, width, max(2, round(log2(max(n, 2))))))
    bits = -(-width // segments)
    segments = -(-width // bits)
    rows = checkpointed(known.select("id", _segments(width, bits).alias("code")).groupBy("id").agg(F.min("code").alias("code")))
    # One more than k, as a query is no answer to itself.
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    codes = checkpointed(codes)
    queries = rows.where(F.col("id") % every == 0)
    best = search_codes(queries.select("code").distinct(), codes, bits, segments, k + 1)
    found = queries.withColumnRenamed("id", "query_id").join(best, "code").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


#: The same by comparing all pairs.
TOP_K_SQL = """
WITH codes AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, d.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM codes q JOIN codes d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS BIGINT) AS rank, vec_id, distance FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10
"""
