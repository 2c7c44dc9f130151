"""From raw documents to packed training sequences, stage by stage.

Defined cases
* null or empty text: the quality classifier rejects it.
* null doc_id: never a near duplicate; stays, and is packed under a null doc_id.
* null source: a source of its own.  Rows that repeat a doc_id: one of them stays.
* very long texts: whole in every stage.  An empty table gives an empty result.
* other columns, whatever their names, go along to the last stage; packing returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import mixing, neardup, packing, quality, secrets
from lodestrata.llm._scratch import Scratch


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by the name of their rule."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents of each source as its weights demand, in training order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of every document goes: a sequence and a position in it."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, MinHash and best-fit packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each reading what the one before has written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = scratch.table(docs)
            if before is not None:
                scratch.drop(before)  # the stage after it is written
            before = docs
    return docs
