"""Queries on low-rank adapters, tapes and batches beyond the first catalogue, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspan.operators import batch, low_rank, params, stats
from convspan.sources import tables

RANK, SEED = 4, 23


def _shapes(spark, sf_dir) -> DataFrame:
    """A kernel for each label of the vectors, as wide as their number."""
    e = tables.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n"))
    name = low_rank.path_name(F.array(F.lit("layers"), F.col("label").cast("string"), F.lit("attention"), F.lit("kernel")))
    return e.select(name.alias("path"), (F.col("n") + RANK).alias("n_in"), (F.col("label") % 5 + RANK).cast("int").alias("n_out"))


def lora_init(spark, sf_dir):
    found = low_rank.flat(low_rank.init(_shapes(spark, sf_dir), RANK, SEED))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("values"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max(F.abs("value")), 9).alias("most"))


def lora_faults(spark, sf_dir):
    """Adapters of which some are left out, renamed or cut."""
    shapes = _shapes(spark, sf_dir)
    found = low_rank.unflat(low_rank.flat(low_rank.init(shapes, RANK, SEED)))
    label = F.regexp_extract("path", r"\[([0-9]+)\]", 1).cast("int")
    found = found.where(~((label % 4 == 1) & (F.col("part") == "b"))).withColumn("path", F.when((label % 4 == 2) & (F.col("part") == "a"), F.concat("path", F.lit("_old"))).otherwise(F.col("path")))
    return low_rank.faults(shapes, found.where(~((label % 4 == 3) & (F.col("part") == "b") & (F.col("j") == 0) & (F.col("i") == 1))), RANK)


def _rows(spark, sf_dir) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select(F.lit("w").alias("path"), F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).withColumn("value", F.col("x").cast("double")).drop("x")


def parameter_names(spark, sf_dir):
    """Names of paths, and null for such as are none."""
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id")
    parts = F.when(F.col("vec_id") % 5 == 0, F.array(F.lit("layers"), F.col("vec_id").cast("string"), F.lit("not a name"))).otherwise(F.array(F.lit("layers"), F.col("vec_id").cast("string"), F.lit("mlp"), F.lit("0")))
    return e.select("vec_id", low_rank.path_name(parts).alias("name"))


def dtype_histogram(spark, sf_dir):
    """Tensors and parameters of each kind of number in the tables of vectors and parts."""
    kinds = [(name, f.name, f.dataType.simpleString()) for name in ("embeddings", "conversations") for f in tables.table(spark, sf_dir, name).schema]
    rows = None
    for name, column, kind in kinds:
        own = tables.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("values")).select(F.lit(kind).alias("dtype"), "values")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"), F.sum("values").alias("values"))


def flatten_batch(spark, sf_dir):
    """The rows of an epoch by device and back."""
    o = batch.shuffled(tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id")).distinct(), 17)
    placed = o.select("sample_id", "position", *[c.cast("long").alias(n) for n, c in batch.index_columns(F.col("position"), 2, 2, 2, 2).items()])
    return placed.select("sample_id", batch.flat_index(2, 2, 2, 2).alias("flat"), "position")


def source_report(spark, sf_dir):
    """Rows, bytes and a fingerprint of each source: the sum of 32 bits of its texts' hashes."""
    d = tables.table(spark, sf_dir, "documents")
    part = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8), 16, 10).cast("long")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.sum(part).alias("fingerprint"))


def key_audit(spark, sf_dir):
    """Keys that only one of two tables has, and those of both."""
    d, l = (tables.table(spark, sf_dir, n).select("doc_id").where("doc_id is not null").distinct() for n in ("documents", "labels"))
    tell = lambda frame, name: frame.agg(F.lit(name).alias("keys"), F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"))
    return tell(d.intersect(l), "both").unionByName(tell(d.exceptAll(l), "documents only")).unionByName(tell(l.exceptAll(d), "labels only"))


def loss_statistics_causal(spark, sf_dir):
    """Vectors as logits of samples of ten places: each place tells the next one's label."""
    e = tables.table(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 10).alias("sample_id"), (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("logits"), F.col("label").alias("token"), (F.col("vec_id") % 4).cast("double").alias("weight"))
    s = stats.loss_statistics(stats.causal(rows))
    return s.select(F.round("numerator", 3).alias("numerator"), "denominator", "correct_weight", "token_count")


def trajectory_report(spark, sf_dir):
    """Errors between the daily sums of even and odd events."""
    e = tables.table(spark, sf_dir, "events").withColumn("step", F.floor(F.unix_timestamp("ts") / 86400).cast("long"))
    daily = lambda side: e.where(F.col("event_id") % 2 == side).groupBy("step").agg(F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("value"))
    found = stats.error_report(stats.compare_trajectories(daily(0), daily(1)))
    return found.select("paired_steps", "unpaired_steps", *[F.round(c, 4).alias(c) for c in ("most_abs", "mean_abs", "most_rel", "mean_rel")], "worst_step")


def adamw_first_step(spark, sf_dir):
    """The first step from moments of zero."""
    weights = _rows(spark, sf_dir).withColumns({"ndim": F.lit(2), "grad": F.col("value") * 0.25})
    moved = params.adamw_step(params.adamw_init(weights), 1, 0.1)
    return moved.groupBy("path").agg(F.round(F.sum("value"), 4).alias("value"), F.round(F.sum("m"), 5).alias("m"), F.round(F.sum("v"), 7).alias("v"))


def queries() -> dict:
    return {f.__name__: f for f in (lora_init, lora_faults, parameter_names, dtype_histogram, flatten_batch, source_report, key_audit, loss_statistics_causal, trajectory_report, adamw_first_step)}


SHAPES = "s AS (SELECT 'layers[' || label || '].attention.kernel' AS path, label, count(*) + 4 AS n_in, label % 5 + 4 AS n_out FROM embeddings GROUP BY label)"
DRAW = "CAST('0x' || substr(sha256('23:' || path || ':' || i || ':' || j), 1, 12) AS BIGINT) / 281474976710656.0"
SQL = {
    "lora_init": f"WITH {SHAPES}, r AS (SELECT path, n_in, unnest(range(n_in)) AS i FROM s), a AS (SELECT r.*, j.range AS j FROM r, range(4) j), v AS (SELECT path || '.lora_a' AS name, (({DRAW}) * 2 - 1) / sqrt(n_in) AS value FROM a UNION ALL SELECT path || '.lora_b', 0.0 FROM s, range(4) i, range(20) j WHERE j.range < n_out) SELECT name, CAST(count(*) AS BIGINT) AS values, round(sum(value), 6) AS total, round(max(abs(value)), 9) AS most FROM v GROUP BY 1",
    "lora_faults": f"WITH {SHAPES} SELECT path, 'b' AS part, CASE label % 4 WHEN 1 THEN 'missing' ELSE 'another shape' END AS fault FROM s WHERE label % 4 IN (1, 3) UNION ALL SELECT path, 'a', 'missing' FROM s WHERE label % 4 = 2 UNION ALL SELECT path || '_old', 'a', 'unexpected' FROM s WHERE label % 4 = 2",
    "parameter_names": "SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 'layers[' || vec_id || '].mlp[0]' END AS name FROM embeddings",
    "dtype_histogram": "WITH e AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT count(*) AS n FROM conversations), k(dtype, n) AS (SELECT 'bigint', n FROM e UNION ALL SELECT 'array<float>', n FROM e UNION ALL SELECT 'int', n FROM e UNION ALL SELECT 'bigint', n FROM c UNION ALL SELECT 'bigint', n FROM c UNION ALL SELECT 'string', n FROM c UNION ALL SELECT 'string', n FROM c) SELECT dtype, CAST(count(*) AS BIGINT) AS columns, CAST(sum(n) AS BIGINT) AS values FROM k GROUP BY 1",
    "flatten_batch": "WITH o AS (SELECT conv_id AS sample_id, row_number() OVER (ORDER BY sha256('17:' || conv_id), conv_id) - 1 AS position FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT sample_id, position AS flat, position FROM o",
    "loss_statistics_causal": "WITH l AS (SELECT vec_id // 10 AS s, CAST(embedding AS DOUBLE[]) AS x, lead(label) OVER w AS target, CAST(lead(vec_id % 4) OVER w AS DOUBLE) AS weight FROM embeddings WINDOW w AS (PARTITION BY vec_id // 10 ORDER BY vec_id)), loss AS (SELECT *, ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[target + 1] AS loss FROM l WHERE target IS NOT NULL) SELECT round(sum(loss * weight), 3) AS numerator, sum(weight) AS denominator, sum(CASE WHEN list_position(x, list_max(x)) - 1 = target THEN weight ELSE 0 END) AS correct_weight, CAST(count(*) FILTER (weight > 0) AS BIGINT) AS token_count FROM loss",
    "trajectory_report": "WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, event_id % 2 AS side, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) AS value FROM events GROUP BY 1, 2), e AS (SELECT coalesce(a.step, b.step) AS step, abs(a.value - b.value) AS ab, abs(a.value - b.value) / greatest(abs(b.value), 1e-12) AS re FROM (SELECT * FROM d WHERE side = 0) a FULL JOIN (SELECT * FROM d WHERE side = 1) b ON a.step = b.step) SELECT CAST(count(ab) AS BIGINT) AS paired_steps, CAST(count(*) - count(ab) AS BIGINT) AS unpaired_steps, round(max(ab), 4) AS most_abs, round(avg(ab), 4) AS mean_abs, round(max(re), 4) AS most_rel, round(avg(re), 4) AS mean_rel, (SELECT step FROM e ORDER BY re DESC NULLS LAST, step LIMIT 1) AS worst_step FROM e",
    "adamw_first_step": "WITH s AS (SELECT CAST(v AS DOUBLE) AS value, CAST(v AS DOUBLE) * 0.25 AS grad FROM (SELECT unnest(embedding) AS v FROM embeddings)), g AS (SELECT sqrt(sum(grad * grad)) AS norm FROM s), c AS (SELECT value, grad * least(1.0, 1.0 / (norm + 1e-6)) AS grad FROM s, g) SELECT 'w' AS path, round(sum(value - 0.1 * (grad / (sqrt(grad * grad) + 1e-8) + 0.1 * value)), 4) AS value, round(sum(0.1 * grad), 5) AS m, round(sum(0.05 * grad * grad), 7) AS v FROM c",
    "source_report": "SELECT source, CAST(count(*) AS BIGINT) AS rows, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(sha256(coalesce(text, '')), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM documents GROUP BY 1",
    "key_audit": "WITH d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), l AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL), b AS (SELECT coalesce(d.doc_id, l.doc_id) AS id, d.doc_id IS NOT NULL AS ind, l.doc_id IS NOT NULL AS inl FROM d FULL JOIN l USING (doc_id)), k(name, a, c) AS (VALUES ('both', true, true), ('documents only', true, false), ('labels only', false, true)) SELECT name AS keys, CAST(count(id) AS BIGINT) AS rows, CAST(sum(id) AS BIGINT) AS ids FROM k LEFT JOIN b ON ind = a AND inl = c GROUP BY 1",
}
