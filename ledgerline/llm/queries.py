"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import filteraudit, vectorcodes
from ledgerline.llm.storage import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_keys: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The secret in spark.ledgerline.pii.key; one made for this application where that is unset, so that nobody else knows it."""
    return spark.conf.get("spark.ledgerline.pii.key", None) or _keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), 4096, 1)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.suffixes import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), 400)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.lmscore import score

    return score(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.pii import mask_report

    return mask_report(read(spark, sf_dir, "documents"), pii_key(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.language import fit, identify

    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.tokencount import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.toxicity import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.media import audio_summary

    return audio_summary(read(spark, sf_dir, "documents"))


def op11_fuzzy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.fuzzyhash import half_edits

    return half_edits(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.filteraudit import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.vectorcodes import compress

    return compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_lm_scoring, op3_minhash, op4_pii, op5_language_id, op6_token_counts, op7_decontamination, op8_toxicity, op9_audio_features, op10_best_fit_packing, op11_fuzzy_fingerprints, op12_filter_audit, op13_vector_codes)}
ORACLE: dict[str, str] = {"op12_filter_audit": filteraudit.SQL, "op13_vector_codes": vectorcodes.SQL}
