"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage works on all that its predecessor kept, and all but the last return the columns of documents, further ones
too, whatever their names. An empty table goes through every stage and gives no rows. Rows that repeat one another are
decided alike by the first two stages; the third takes each for a copy of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import neardup, packing, pii, quality, suffix_dedup
from tagloom.llm.common import discard, written
from tagloom.llm.queries import WORD_TOKENIZER


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits or lie far from their language and source go; so do null and empty texts."""
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id. Rows without a doc_id or without words stay."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are cut out; null texts stay null, and texts may become empty."""
    return _recounted(suffix_dedup.deduplicated(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, gives way to its kind in brackets; null texts stay null."""
    return _recounted(pii.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences; null and empty texts are one end mark each."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]

#: No SQL has signatures' candidates, robust estimates or packing; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
