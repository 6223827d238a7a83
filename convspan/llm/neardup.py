"""Near-duplicate documents: MinHash with banding, verification by signature and by full sets, connected components.

A document's set holds its distinct shingles of five words. Documents with the same set are one class, of which only the least doc_id
goes on. Bands of minima of many universal hashes put classes into buckets. In a bucket every class is paired with two centres, chosen
by hash, not with all others; pairs whose signatures agree well enough are confirmed on the full sets, and the confirmed links give
components. What the centres leave open is closed by a second pass: where a bucket still holds several components, the classes outside
its most frequent one are compared with all others of the bucket. In small buckets that is a join with the signatures in its
condition, and what passes is again confirmed on the full sets. Large buckets with the same most frequent component, mostly the same
classes again and again, are put together, cut into square blocks of classes with their full sets, and only links leave a block. So
no link between classes that share a bucket is lost, and no group is expanded into all its pairs.

A link of similarity s shares no bucket with probability (1 - s ** ROWS) ** BANDS: 0.0000023 at 0.75, 0.0000008 at 0.76, less beyond,
and its signatures are too unlike with about the same.

Shingles are told apart by 64 bits, mixed at each word and within words (long ones have a cryptographic hash), so no repetitive text
makes unlike ones agree, and a full set of 10,000 shingles holds two that agree by chance once in 10 ** 11 sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspan.llm.common import BROADCAST_ROWS, HUB_ROWS, checkpointed, join_hubs, small_arrow_batches, text_or_empty
from convspan.llm.components import connected_components, parts_for
from convspan.llm.textarrays import STEP, chunks, digests, mix, utf8, windows, word_hashes, words

SHINGLE = 5
BANDS, ROWS = 48, 5
#: A link has at least this similarity, in hundredths.
SIMILARITY = 75
#: Two bits of each minimum; a pair is confirmed if at most so many of all bits differ: similarity 0.75 less 4.7 standard errors.
MOST_DIFFERENT = int(BANDS * ROWS * 2 * (1 - 0.58) / 2)
#: Bytes of full sets that are compared in one group, about.
GROUP_BYTES = 16_000_000
_rng = np.random.default_rng(75)
FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
ADDED = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
#: Classes in a bucket up to which its open pairs come from a join; larger ones go through blocks, of so many classes a side.
SMALL_BUCKET, BLOCK = 24, 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; texts under five words have their whole sequence as one."""
    for first, last in chunks(texts):
        data, offsets = utf8(texts.slice(first, last - first))
        data = LOWER[data]
        begins, ends, runs = words(data, offsets)
        word = word_hashes(data, begins, ends)
        every = windows(word, SHINGLE)
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(every[a : b - SHINGLE + 1])
            elif b > a:
                yield digests([word[a:b].tobytes()])
            else:
                yield np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS * ROWS minima for each non-empty set."""
    at = np.cumsum([0, *map(len, sets)])[:-1]
    shingles = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(FACTORS), len(sets)), np.uint32)
    for k, (a, b) in enumerate(zip(FACTORS, ADDED, strict=True)):
        out[k] = np.minimum.reduceat(shingles * a + b, at)
    return out.T


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the hashes of its bands and its sketch, as longs."""
    found = minima(sets).astype(np.uint64)
    bands = found.reshape(len(sets), BANDS, ROWS)
    key = np.full((len(sets), BANDS), STEP, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key ^ bands[:, :, k]) + np.uint64(k)
    bits = mix(found)
    pair = np.stack([bits & np.uint64(1), bits >> np.uint64(1) & np.uint64(1)], axis=2).reshape(len(sets), -1).astype(np.uint8)
    pair = np.pad(pair, ((0, 0), (0, -pair.shape[1] % 64)))
    return key.view(np.int64), np.ascontiguousarray(np.packbits(pair, axis=1)).view(np.int64)


LONGS = -(-BANDS * ROWS * 2 // 64)
SKETCH = [f"s{k}" for k in range(LONGS)]
FACTS = "doc_id long, n long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    salt = np.uint64(STEP)
    pairs = [(mix(s).sum(dtype=np.uint64), mix(s ^ salt).sum(dtype=np.uint64)) for s in sets]
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return both[:, 0], both[:, 1]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, last in chunks(texts):
            sets = list(shingle_sets(texts.slice(first, last - first)))
            n = np.array(list(map(len, sets)), np.int64)
            some = np.flatnonzero(n)
            bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), LONGS), np.int64)
            if len(some):
                bands[some], sketch[some] = _signatures([sets[k] for k in some])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            k1, k2 = _keys(sets)
            own = range(2, batch.num_columns)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array(n), pa.array(k1), pa.array(k2), flat, *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(LONGS)), *(batch.column(k).slice(first, last - first) for k in own)],
                ["doc_id", "n", "k1", "k2", "bands", *SKETCH, *(batch.schema.names[k] for k in own)],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in chunks(batch.column(1)):
            sets = list(shingle_sets(batch.column(1).slice(first, last - first)))
            k1, k2 = _keys(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "k1", "k2", "shingles"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)


def _group_links(key: tuple, table: pa.Table) -> pa.Table:
    """The links among a group's pairs; a row without v brings u's set, one with v that of v."""
    u, sets = table.column("u").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    v = table.column("v").to_pylist()
    centres = {a: s for a, b, s in zip(u, v, sets, strict=True) if b is None}
    found = [(a, b) for a, b, s in zip(u, v, sets, strict=True) if b is not None and _linked(centres[a], s)]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _block_links(key: tuple, table: pa.Table) -> pa.Table:
    """Links between a block's classes outside the main component (side 0) and its classes (side 1), of different components."""
    main, side = key[0].as_py(), table.column("side").to_numpy()
    rep, component, n = (table.column(c).to_numpy() for c in ("rep", "component", "n"))
    sketch = np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1).view(np.uint64)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    every, found = np.flatnonzero(side == 1), []
    for i in np.flatnonzero(side == 0).tolist():
        other = every[(component[every] != component[i]) & ((component[every] == main) | (rep[every] > rep[i]))]
        other = other[np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * SIMILARITY]
        other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(1) <= MOST_DIFFERENT]
        found += [(min(rep[i], rep[j]), max(rep[i], rep[j])) for j in other.tolist() if _linked(sets[i], sets[j])]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _alike(a: str, b: str) -> Column:
    """Whether two classes' sizes and sketches allow a link."""
    different = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    sizes = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) * 100 >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * SIMILARITY
    return sizes & (different <= MOST_DIFFERENT)


def _full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles of the classes whose rep is among ids(id)."""
    wanted = checkpointed(classes.select(F.col("rep").alias("id"), "doc", "k1", "k2").join(ids.distinct(), "id"))
    rows = wanted.count()
    wanted = wanted.coalesce(parts_for(rows))
    own = wanted.select("doc").distinct()
    own = F.broadcast(own) if rows <= BROADCAST_ROWS else own
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).join(own, "doc")
    sets = texts.mapInArrow(_sets, "doc long, k1 long, k2 long, shingles binary")
    return sets.join(wanted, ["doc", "k1", "k2"]).select("id", "shingles").dropDuplicates(["id"])


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among pairs(u, v, nv) of classes, a frame from files, nv being the size of v's set, from the full sets of their texts.

    A v is in few pairs, a u may be in very many: the pairs of one u are dealt by v into parts of about GROUP_BYTES, and u's set goes
    once to each group that has a part of it.
    """
    size, rows = pairs.agg(F.sum("nv"), F.count(F.lit(1))).first()
    if not rows:
        return pairs.select("u", "v")
    pairs, groups = pairs.coalesce(parts_for(rows)), 1 + size * 8 // GROUP_BYTES
    sets = _full_sets(docs, classes, pairs.select(F.explode(F.array("u", "v")).alias("id")))
    parts = pairs.groupBy("u").agg(F.ceil(F.sum("nv") * 8 / GROUP_BYTES).alias("parts")).where("parts > 1")
    dealt = pairs.join(F.broadcast(parts) if groups <= BROADCAST_ROWS else parts, "u", "left")  # fewer such u than groups
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)).cast("long"))
    dealt = dealt.select("u", "v", F.pmod(F.xxhash64("u", part), F.lit(groups)).alias("group"))
    one = dealt.select("group", "u", F.lit(None).cast("long").alias("v")).distinct().join(sets.withColumnRenamed("id", "u"), "u")
    two = dealt.join(sets.withColumnRenamed("id", "v"), "v")
    return checkpointed(one.select("group", "u", "v", "shingles").unionByName(two.select("group", "u", "v", "shingles")).groupBy("group").applyInArrow(_group_links, "u long, v long"))


def _links_in_blocks(docs: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """Links of several(main, rep, component): of each main's classes outside it with all of its classes.

    Both sides are dealt into blocks of about BLOCK classes by hash, and every block of the one meets every block of the other.
    """
    rows = several.join(_full_sets(docs, classes, several.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep"), "rep").join(classes.select("rep", "n", *SKETCH), "rep")
    outside = F.col("component") != F.col("main")
    sizes = several.groupBy("main").agg(F.ceil(F.count_if(outside) / BLOCK).cast("int").alias("few"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"))
    rows = rows.join(sizes, "main")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    one = rows.where(outside).withColumns({"side": F.lit(0), "x": block("few")}).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    two = rows.withColumns({"side": F.lit(1), "y": block("all")}).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    return checkpointed(one.unionByName(two).groupBy("main", "x", "y").applyInArrow(_block_links, "u long, v long"))


def find_components(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text), then keys, long columns of docs that the rows bring along.

    Rows whose texts' sets have 100 * intersection >= 75 * union are linked; component_id is the least doc_id that links reach from a
    row, its own included, and kept says whether it is its own. A text without words (null, empty) is linked with nothing, likewise a
    row with a null doc_id, whose component_id is null and which is kept. Repeated rows have the same result; rows of one doc_id with
    different texts are judged by their own texts. Other columns are ignored; an empty table gives an empty one.
    """
    small_arrow_batches(docs)
    facts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *keys).mapInArrow(_facts, ", ".join([FACTS, *(f"{k} long" for k in keys)]))
    facts = checkpointed(facts)
    linked = facts.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    # A class is named by its least doc_id; of several classes with the same one the first is, the others by a hash.
    names = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"))
    firsts = names.groupBy("doc").agg(F.min(F.struct("k1", "k2")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    firsts = checkpointed(firsts)
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    other = F.col("first").isNotNull() & (F.struct("k1", "k2") != F.col("first"))
    names = names.join(firsts, "doc", "left").select("k1", "k2", "doc", F.when(other, F.xxhash64("doc", "k1", "k2")).otherwise(F.col("doc")).alias("rep"))
    classes = linked.drop(*keys).withColumnRenamed("doc_id", "doc").join(names, ["doc", "k1", "k2"]).dropDuplicates(["doc", "k1", "k2"])
    classes = checkpointed(classes)
    sketches = classes.select("rep", "n", *SKETCH)
    members = classes.select("rep", F.explode("bands").alias("bucket"))

    # Two centres a bucket, each by one hash for all buckets, so that few different pairs arise.
    order = lambda seed: F.min(F.struct(F.xxhash64("rep", F.lit(seed)).alias("order"), "rep"))
    centres = members.groupBy("bucket").agg(order(1).alias("one"), order(2).alias("two"), F.count(F.lit(1)).alias("size")).where("size > 1")
    centres = checkpointed(centres.select("bucket", F.col("one.rep").alias("one"), F.col("two.rep").alias("two"), "size"))
    # Buckets of very many classes are told their centres by a broadcast, as their classes would all meet in one task.
    large = F.broadcast(centres.where(F.col("size") > HUB_ROWS).drop("size"))
    rest = members.join(large.select("bucket"), "bucket", "left_anti").join(centres.drop("size"), "bucket")
    shared = checkpointed(members.join(large, "bucket").unionByName(rest))
    stars = shared.select("rep", F.explode(F.array("one", "two")).alias("centre")).where("rep <> centre")
    # A pair of two centres comes once; the centre, which may have very many others, is u.
    pairs = stars.groupBy(F.least("rep", "centre").alias("low"), F.greatest("rep", "centre").alias("high")).agg(F.min("centre").alias("u"))
    pairs = checkpointed(pairs.select("u", F.when(F.col("u") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("v")))
    a, b = (sketches.select(F.col("rep").alias(side), F.struct("n", *SKETCH).alias(name)) for side, name in (("u", "a"), ("v", "b")))
    rows = pairs.count()
    pairs = join_hubs(pairs.coalesce(parts_for(rows)), a, "u", rows).join(b, "v").where(_alike("a", "b"))
    tried = checkpointed(pairs.select("u", "v", F.col("b.n").alias("nv")))
    links = _confirmed(docs, classes, tried)
    component = connected_components(links)

    # Buckets that still hold several components: classes outside the most frequent one, against all.
    placed = shared.select("bucket", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    placed = checkpointed(placed.select("bucket", "rep", F.coalesce("component", "rep").alias("component")))
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    shares = shares.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("size")).where("parts > 1").drop("parts")
    several = placed.join(shares, "bucket")
    small = several.where(F.col("size") <= SMALL_BUCKET).join(sketches, "rep")
    fewer, every = small.where("component <> main").alias("a"), small.alias("b")
    new = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.rep") < F.col("b.rep")))
    more = fewer.join(every, (F.col("a.bucket") == F.col("b.bucket")) & new & _alike("a", "b"))
    more = more.select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"), F.col("b.n").alias("nv")).distinct()
    known = tried.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("pair")).select("pair.u", "pair.v")
    more = more.join(known, ["u", "v"], "left_anti")
    large = checkpointed(several.where(F.col("size") > SMALL_BUCKET).select("main", "rep", "component").distinct())
    found = [_confirmed(docs, classes, checkpointed(more))] + ([] if large.isEmpty() else [_links_in_blocks(docs, classes, large)])
    found = [f for f in found if not f.isEmpty()]
    if found:
        component = connected_components(functools.reduce(DataFrame.unionByName, found, links))

    named = names.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "doc", F.coalesce("component", "rep").alias("component"))
    # Components whose least node is no doc_id, or not their least.
    least = checkpointed(named.groupBy("component").agg(F.min("doc").alias("least")).where("least <> component"))
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    named = named.join(least, "component", "left").select("k1", "k2", F.coalesce("least", "component").alias("component_id"))
    rows = facts.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2", *keys).join(named, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.withColumn("component_id", own.cast("long")).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *keys)
