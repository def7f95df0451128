"""A training-data pipeline over `documents`: each stage works on all rows that the stage before it kept.

Language ID drops texts without a language, near-duplicates keep the smallest document of each class, decontamination
drops documents that hold a benchmark passage, the secret scan masks what it finds, and encoding returns token ids.
All stages but the last return the columns of documents. Rows without text have no language and go in the first stage.
Extra columns of documents stay up to the last stage, whatever their names; it returns its own columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import bpe, decontaminate, langid, secrets, simhash
from shelfline.llm.common import crc_mod, fresh, written

LEAST_SCORE = 0.5  # of the predicted language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language; lang becomes the predicted one where it was null."""
    model, pred, score = langid.fit(docs.where(crc_mod("doc_id", 4) != 2)), fresh(docs, "_pred"), fresh(docs, "_score")
    judged = langid.predict(docs, model, pred=pred, score=score).where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE))
    return judged.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the smallest doc_id, null last, and of rows that share it the smallest text hash."""
    key, name = fresh(docs, "_key"), fresh(docs, "_first")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    first = simhash.classes(keyed, key=key).where(F.col(key) == F.col("component_id")).select(F.to_json(key, {"ignoreNullFields": "false"}).alias(name)).distinct()
    kept = keyed.withColumn(key, F.to_json(key, {"ignoreNullFields": "false"})).join(first, F.col(key) == F.col(name), "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with a benchmark item, told apart by a hash of their texts."""
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    found = decontaminate.overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    return keyed.join(found.select(key).distinct(), key, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and keeps n_chars true; documents stay."""
    spans = fresh(docs, "_spans")
    masked = secrets.redact(secrets.scan(docs, out=spans), spans=spans)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids as packed 32-bit integers, and digests of the ids and of their decoding."""
    ids = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text")))
    return ids.select(
        "doc_id", "lang", "source", "token_ids", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("encoding", encoded),
]

#: SQL has no forward pass over segmentations, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
