"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept and returns the columns of documents, the last one sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontaminate import without_leaks
from ledgerline.llm.minhash import without_near_duplicates
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.pii import mask
from ledgerline.llm.queries import pii_key, tokenizer_path
from ledgerline.llm.storage import discard, materialize, read
from ledgerline.llm.toxicity import clean_documents


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects; null and empty texts score the share of label 1, repeated rows alike."""
    return clean_documents(docs, read(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, and one row of repeated rows; texts without words have no group."""
    return without_near_duplicates(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages; null and empty texts hold none, repeated rows go or stay together."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers and dates by pseudonyms; all rows stay, null texts too."""
    return mask(docs, pii_key(spark))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 4096 tokens; null and empty texts are one end token, repeated rows are packed each."""
    return pack_documents(docs, tokenizer_path(), 4096, 1)


STAGES = [("toxicity", toxicity_stage), ("near duplicates", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("best-fit packing", pack_stage)]
#: Trained models and tokenizers are beyond SQL; tests/llm runs all stages on a fixture with planted rows, and the operators' tests hold most of their parts against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each one's result written to the shared folder and read back by the next, then deleted."""
    docs, written = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(*written)
        written = [docs]
    return docs
