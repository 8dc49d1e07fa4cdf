"""Queries of the training-data operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, langid, license_scan, neardup, packing, pii, piece_codec, quality, suffix_dedup, token_align, topk, vector_codes
from .common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = langid.profiles(docs.filter(~langid.held_out()))
    found = langid.predict(docs, known)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digest(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("d2")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.aligned(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL, public_tokenizers.PATTERN)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_html_extraction, op2_language_id, op3_pii, op4_piece_codec, op5_quality_rules, op6_exact_topk, op7_best_fit_packing, op8_minhash_neardup, op9_license_scan, op10_suffix_dedup, op11_vector_codes, op12_token_alignment, op13_decontamination)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": topk.SQL, "op8_minhash_neardup": neardup.SQL, "op9_license_scan": license_scan.sql(), "op10_suffix_dedup": suffix_dedup.SQL, "op11_vector_codes": vector_codes.sql(), "op13_decontamination": decontaminate.SQL}
