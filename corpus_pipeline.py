"""The corpus pipeline: quality filter, near-dedup, secret scan, mixing and BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm import bpe, dedup, mixing, quality, secrets
from signalframe.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant scores at its threshold or above stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(COLUMNS), labels, bpe.doc_hash() % 5 != 0)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    return dedup.one_of_each(docs.select(COLUMNS), dedup.SHINGLE)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are redacted."""
    return secrets.redact(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce languages repeat until token shares meet the targets; none is dropped."""
    docs = docs.select(COLUMNS)
    listed = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(listed, "doc_id", "left_semi")
    rates = mixing.mix(docs.select("doc_id", "text"), labelled, mixing.TARGETS, least=1.0, grow=True)
    more = rates.where("copies > 1").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    more = written(more, "copies")
    rows = docs.join(more, "doc_id", "left")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (packed '<u4') in place of the text."""
    return bpe.encode_documents(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", dedup_stage),
    ("secret scan", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]
#: SQL can't express the learned stages; tests/llm checks each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
