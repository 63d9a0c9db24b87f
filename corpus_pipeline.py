"""From raw documents to packed training sequences, in stages of the operators.

Each stage works on all that the one before it kept.  Rows with NULL id or
text, empty and repeated rows pass through as the operators define; a row that
repeats id and text counts as a copy of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import decontaminate, ngram_join, packing, quality, secrets
from triagelake.session import checkpoint, measured, new_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select(*COLUMNS), weights, keep=COLUMNS)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Rows of NULL id go where their group has an id; where none has, its
    different texts stay, as no id tells them apart.
    """
    joined = ngram_join.join(docs, hashed=True).withColumnRenamed("doc_id", "lost_id")
    lost = checkpoint(joined.where("not (lost_id <=> component_id)").select("lost_id", "text_hash").distinct())
    gone = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.xxhash64("text") == F.col("text_hash"))
    kept = docs.select(*COLUMNS).join(measured(lost), gone, "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_leaks(docs.select(*COLUMNS), benchmark)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    found = secrets.detect(docs.select(*COLUMNS))
    clean = found.withColumn("text", secrets.masked(F.col("text"), F.col("spans")))
    size = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in a training sequence."""
    # Executors have been through four stages, so words take less of their memory.
    cut = packing.pieces(
        docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), cache=100_000
    )
    light = checkpoint(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(light, ["doc_id", "piece"])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

# Weights, tokens and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = new_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
