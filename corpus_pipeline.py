"""The document pipeline: quality, near copies, benchmark leaks, secrets, pieces.

Every stage takes the documents that its predecessor kept and returns documents; the
last returns their pieces.  Null texts count as empty, repeated rows (equal id and text)
as one document, different texts under one id as several; rows without an id leave
only as exact copies; an empty table gives no rows.  ``run`` writes each stage's result to the shared folder
and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, minhash, pieces, quality, secrets
from marginalia.llm.common import stage, table


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; its voters are labelled rows of ``docs``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_texts(docs, model, docs.columns).filter(F.col("score") >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group with shingle sets of 0.8 or more alike."""
    keep = minhash.near_duplicates(docs, percent=80, words=5).filter("kept OR doc_id IS NULL").select("doc_id")
    named = docs.withColumn("_text", F.xxhash64("text"))
    # Different texts under one id are different documents.
    real = named.join(keep.filter("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "_text"])
    return real.unionByName(named.filter("doc_id IS NULL").dropDuplicates(["_text"])).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_pieces, round_trip`` of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality", judge_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

# Votes of neighbours and best paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
