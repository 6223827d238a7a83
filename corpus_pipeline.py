"""The corpus pipeline: each stage applies one corpus operator to the documents that the stage before kept.

Stages are written as Parquet and read again between each other, in a folder of the session's checkpoint directory, so a lost executor
costs a stage's tasks at most. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspan.llm import mixing, neardup, pieces, pii, toxicity
from convspan.llm.common import WORDS, row_key, shared_folder, table, unused
from convspan.llm.registry import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labels of these documents, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = unused(docs, "score", "predicted")
    return toxicity.score_documents(docs, model, names=(score, predicted)).where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with the least doc_id, and of several such the one with the least row key.

    Rows that are in no group (without words, or without a doc_id) all stay.
    """
    keyed, key = row_key(docs)
    found = neardup.find_components(keyed, tuple(key)).where("kept and doc_id is not null and n_shingles > 0")
    chosen = found.groupBy("component_id").agg(F.min(F.struct(*key)).alias("least")).select(*(F.col("least")[k].alias(k) for k in key))
    kept = keyed.join(chosen, key).dropDuplicates(key)
    alone = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORDS), F.lit(False)))
    return kept.select(*docs.columns).unionByName(alone)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in brackets; n_chars follows the text."""
    base, spans = unused(docs, "base", "spans")
    found = pii.find_personal_data(docs, pii.fit(docs), names=(base, spans)).withColumn("text", pii.mask(spans=spans))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of its sources to the target weights takes it; documents taken 0 times go.

    Rows that agree in all columns come together as many times as the mix takes all of them.
    """
    keyed, key = row_key(docs)
    copies, rows, copy = unused(docs, "copies", "rows", "copy")
    taken = mixing.mix_sources(keyed, keys=tuple(key)).groupBy(*key).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    found = keyed.join(taken.where(F.col(copies) > 0), key)
    found = found.where(F.col(rows) == 1).unionByName(found.where(F.col(rows) > 1).dropDuplicates(key))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256 of every document of the mix."""
    encoded = pieces.encode_documents(docs.select("doc_id", "source", "text"), tokenizer_path())
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("mixing", mix_to_weights),
    ("pieces", encode_pieces),
]

#: SQL can express neither the fitted stages nor the tokenizer; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
