"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, piece encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitchlens.llm import exact_dedup, langid, mixing, pieces, simhash
from pitchlens.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    return langid.keep_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by fingerprints of 3-word shingles within 3 bits the smallest doc_id stays."""
    return simhash.keep_rows(docs, size=3, radius=3)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix of their sources."""
    return mixing.ordered_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document in the files of the mix, its place there, and digests of the ids and the decoded text."""
    placed = mixing.reread_positions(docs.select("doc_id", "text"), "mix_position")
    return pieces.encode(placed, rate=0.1, seed=7, keep=["mix_position"]).select(
        "doc_id", "mix_position", F.size("ids").alias("n_pieces"), "ids", "ids_sha256",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixed), ("pieces", encoded)]

#: Language ID, fingerprints and piece merges cannot be said in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; every result but the last goes through a table in the shared folder."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
