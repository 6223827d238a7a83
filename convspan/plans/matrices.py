"""Queries on tiled matrices, exact sums and packed bytes over all vectors, each beside its DuckDB twin."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.functions import packing
from convspan.functions.exact import exact_sums
from convspan.operators import batch, params, tiles
from convspan.plans.oracle import ALL_MATRICES, ORDER, PADDED
from convspan.sources import tables, tape
from convspan.sources.stage import shared_folder, staged

RANK, SCALE, EDGE = 4, 2.0, 32
BATCH, LENGTH = 4, 64


def _vectors(spark, sf_dir) -> DataFrame:
    """Vectors as rows of the matrix w, numbered by vec_id."""
    return tables.table(spark, sf_dir, "embeddings").select(F.lit("w").alias("path"), F.col("vec_id").alias("i"), F.col("embedding").alias("vector"))


def lora_merge(spark, sf_dir):
    """All vectors plus the product of their first RANK columns with the first RANK vectors, by tiles."""
    v = _vectors(spark, sf_dir)
    w = tiles.of_vectors(v, EDGE)
    a, b = tiles.of_vectors(v.withColumn("vector", F.slice("vector", F.lit(1), F.lit(RANK))), EDGE), tiles.of_vectors(v.where(F.col("i") < RANK), EDGE)
    return tiles.numbers(tiles.merge(w, a, b, SCALE), EDGE).select("i", "j", F.round("value", 6).alias("value"))


def lora_param_count(spark, sf_dir):
    """Numbers of the two adapters of all vectors, by tiles."""
    v = _vectors(spark, sf_dir)
    a, b = tiles.of_vectors(v.withColumn("vector", F.slice("vector", F.lit(1), F.lit(RANK))), EDGE), tiles.of_vectors(v.where(F.col("i") < RANK), EDGE)
    return a.unionByName(b).groupBy("path").agg(F.sum(F.size("values").cast("long")).alias("parameters"))


def lora_linear(spark, sf_dir):
    """All vectors through a layer whose matrices are given by a rule, by tiles."""
    grid = lambda n, m, value: spark.range(n * m).select(F.lit("w").alias("path"), F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j")).withColumn("value", value)
    w, a, b = grid(64, 8, ((F.col("i") * 3 + F.col("j")) % 7 - 3) / 8.0), grid(64, RANK, ((F.col("i") + F.col("j") * 2) % 5 - 2) / 4.0), grid(RANK, 8, ((F.col("i") * 2 + F.col("j")) % 3 - 1) / 2.0)
    found = tiles.linear(tiles.of_vectors(_vectors(spark, sf_dir), EDGE), *(tiles.of_numbers(m, EDGE) for m in (w, a, b)), SCALE)
    return tiles.numbers(found, EDGE).select("i", "j", F.round("value", 5).alias("value"))


def exact_label_sums(spark, sf_dir):
    """Sums of the numbers of each label's vectors and of their absolutes, to the last bit."""
    e = tables.table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    return exact_sums(e, {"total": F.col("x"), "size": F.abs("x")}, ["label"])


def packed_identities(spark, sf_dir):
    """Hash of the bytes of each vector's id, label and numbers."""
    e = tables.table(spark, sf_dir, "embeddings")
    parts = F.unhex(packing.digits(F.col("vec_id"), "bigint")), F.unhex(packing.digits(F.col("label"), "int")), packing.packed(F.col("embedding").cast("array<float>"), "float")
    return e.select("vec_id", packing.digest(*parts).alias("identity"))


def _tape_rows(spark, sf_dir) -> DataFrame:
    """The whole steps of the first epoch's padded samples that carry weight: step, item and arrays."""
    from convspan.plans.catalogue import _order, _padded

    # Staged before they are numbered, as numbering reads them twice.
    rows = staged(batch.placed(_padded(spark, sf_dir), _order(spark, sf_dir)).where(F.exists("loss_weights", lambda w: w > 0)).select("position", *tape.ARRAYS))
    whole = rows.count() // BATCH * BATCH
    numbered = batch.number_emitted(rows.withColumns({"rank": F.lit(0), "epoch": F.lit(0)}), F.lit(True))
    return staged(numbered.where(F.col("emitted_index") < whole).select(F.floor(F.col("emitted_index") / BATCH).alias("step"), (F.col("emitted_index") % BATCH).alias("item"), *tape.ARRAYS))


def tape_source(spark, sf_dir):
    """A tape of all samples, written and read by its data source; its first step is passed by a cursor."""
    rows = _tape_rows(spark, sf_dir)
    path = f"{shared_folder(spark)}/tape-{uuid.uuid4().hex}"
    name = lambda text: hashlib.sha256(text.encode()).hexdigest()
    facts = {
        "recipe_identity": name("recipe"), "tokenizer_identity": name("words"), "pad_token_id": 0, "stream_counters": {}, "model": {"repo_id": "m", "revision": "1"},
        "data": {"repo_id": "d", "revision": "1", "config": "default", "split": "train", "adapter": "messages", "renderer": "qwen2_5_math", "loading_mode": "materialized"},
    }
    manifest = tape.write_tape(rows, path, facts, rows.count() // BATCH, BATCH, LENGTH)
    read = tape.TapeCursor.load(json.loads(json.dumps(tape.TapeCursor(manifest["identity"], 1).save())), manifest, 1).rest(spark, path)
    ids = F.aggregate(F.transform("input_ids", lambda x, p: x.cast("long") * (p + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return read.select("step", "item", ids.alias("ids"), F.size(F.filter("attention_mask", lambda m: m)).cast("long").alias("real"), F.aggregate("loss_weights", F.lit(0.0), lambda s, w: s + w).alias("weight"))


def exact_norm(spark, sf_dir):
    """The norm of all numbers of the vectors, from an exact sum of squares."""
    e = tables.table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("grad"))
    return params.global_norm(e, exact=True).select(F.round("norm", 9).alias("norm"))


def queries() -> dict:
    return {f.__name__: f for f in (lora_merge, lora_param_count, lora_linear, exact_label_sums, exact_norm, packed_identities, tape_source)}


FIXED = "CAST(sum(CAST({} * 1125899906842624.0 AS BIGINT)) AS DOUBLE) / 1125899906842624.0"
SWAPPED = "substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2)"
HEX = "hex(CAST(CAST(CAST(x AS FLOAT) AS BIT) AS BLOB))"
SQL = {
    "lora_merge": f"WITH {ALL_MATRICES}, d AS (SELECT a.i, b.j, sum(a.value * b.value) AS delta FROM w a JOIN w b ON a.j = b.i WHERE a.j < 4 AND b.i < 4 GROUP BY ALL) SELECT w.i, w.j, round(w.value + coalesce(d.delta, 0) * 2.0, 6) AS value FROM w LEFT JOIN d ON w.i = d.i AND w.j = d.j",
    "lora_param_count": f"WITH {ALL_MATRICES} SELECT 'w' AS path, CAST(count(*) FILTER (j < 4) + count(*) FILTER (i < 4) AS BIGINT) AS parameters FROM w",
    "lora_linear": "WITH x AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT k.range AS k, c.range AS c, ((k.range * 3 + c.range) % 7 - 3) / 8.0 + 2.0 * (SELECT sum((((k.range + r.range * 2) % 5 - 2) / 4.0) * (((r.range * 2 + c.range) % 3 - 1) / 2.0)) FROM range(4) r) AS w FROM range(64) k, range(8) c) SELECT i, c AS j, round(sum(v * w), 5) AS value FROM x JOIN m ON x.j = m.k GROUP BY 1, 2",
    "exact_label_sums": f"WITH n AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, {FIXED.format('x')} AS total, {FIXED.format('abs(x)')} AS size FROM n GROUP BY 1",
    "exact_norm": "SELECT round(sqrt(fsum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 9) AS norm FROM (SELECT unnest(embedding) AS x FROM embeddings)",
    "packed_identities": f"WITH n AS (SELECT vec_id, label, k, {HEX} AS h FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding) AS x FROM embeddings)), g AS (SELECT vec_id, any_value(label) AS label, string_agg({SWAPPED.format('h')}, '' ORDER BY k) AS h FROM n GROUP BY 1) "
                         "SELECT vec_id, sha256(unhex(string_agg(printf('%02x', (vec_id >> (8 * b)) & 255), '' ORDER BY b) || (SELECT string_agg(printf('%02x', (label >> (8 * b2)) & 255), '' ORDER BY b2) FROM range(4) r2(b2)) || any_value(h))) AS identity FROM g, range(8) r(b) GROUP BY vec_id, label",
    "tape_source": f"WITH {PADDED}, {ORDER}, f AS (SELECT sample_id, sum(token_id * (place + 1)) AS ids, count(*) AS real, sum(weight) AS weight FROM inside GROUP BY 1), p AS (SELECT f.*, row_number() OVER (ORDER BY position) - 1 AS k, count(*) OVER () // 4 * 4 AS whole FROM f JOIN o USING (sample_id) WHERE weight > 0) "
                   "SELECT k // 4 AS step, k % 4 AS item, CAST(ids AS BIGINT) AS ids, CAST(real AS BIGINT) AS real, CAST(weight AS DOUBLE) AS weight FROM p WHERE k < whole AND k >= 4",
}
