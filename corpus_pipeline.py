"""Cleaning of a training corpus: five stages, each reading what the one before kept.

Every stage takes (spark, docs, sf_dir) and gives the columns of ``documents``; the last one adds token columns.  Their
results are written as Parquet to the shared folder and read again.  Rows that a stage keeps are left as they are,
except for live secrets, which are masked.  Null and empty texts pass all stages: they are neither toxic nor leaked nor
copies.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import bpe, decontamination, near_dedup, secrets, toxicity
from tarmac.llm.common import discard, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below the threshold, learnt from the labelled ones of these documents."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return near_dedup.representatives(docs, "doc_id", percent=85)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets masked; ``n_chars`` follows the text."""
    out = secrets.redacted(docs, secrets.scan(docs, "doc_id", by_text=True), "doc_id")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token counts and digests of their ids and of what these decode to."""
    return bpe.with_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: A trained network decides in the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(spark, docs)
        docs = out
    return docs
