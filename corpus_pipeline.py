"""A corpus pipeline over ``documents``: five stages, each written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm import byte_bpe, decontaminate, near_copies, personal_data, quality, rows
from rinkspark.llm.queries import RANKS

#: Documents scored below this are rejected.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = rows.fresh(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= QUALITY).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash links and what lies beyond their radius, verified: five-word shingles, similarity 0.8).

    It is the one with the smallest id; rows without an id stay.
    """
    found = near_copies.near_copies(docs)
    others = rows.counted(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(rows.small(others), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return personal_data.masked(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): every document's tokens, and whether decoding gives its bytes back."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    decoded = byte_bpe.encode_and_decode(docs, path, pattern, keep_text=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("tokens", token_stage),
]

#: Classifier, fingerprints and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


#: Whether Spark deletes a query's shuffle files when the query ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stage's result written to the shared folder and read again, and deleted once the next is written.

    While they run, shuffle files go when their query ends: no later query reads them, and until the driver
    collects garbage those of hundreds of queries would pile up. The session's own setting comes back after.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    kept = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        for _, stage in STAGES:
            docs = rows.written(stage(spark, docs, sf_dir))
            if before is not None:
                rows.dropped(before)
            before = docs
    finally:
        spark.conf.set(CLEANED, kept)
    return docs
