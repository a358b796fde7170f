"""A training corpus from documents: quality rules, near-duplicates, decontamination, SentencePiece encoding.

Defined cases, in every stage: a null or empty text fails the quality rules, so none comes further (the other stages by
themselves keep it); very long texts are worked through whole; of rows that repeat a doc_id and a text one is kept, a null
doc_id is never a copy of anything; ties go as each operator states; an empty table gives an empty table of the same
columns; extra columns, whatever their names, come through (`pieces` and `n_pieces` are replaced by the last stage).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, near_dups, quality, sentencepiece
from siltstone.llm.shared import materialize, prepare, work_dir

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of smallest doc_id."""
    prepare(spark)
    return near_dups.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text that is left: all columns, pieces (packed ids), n_pieces."""
    prepare(spark)
    encoded = sentencepiece.encode_documents(docs.drop("n_pieces"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.selectExpr("*", "cast(octet_length(pieces) div 4 as bigint) as n_pieces")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept, each written as Parquet and read again."""
    prepare(spark)
    docs, where = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{where}/{i}")
    return docs
