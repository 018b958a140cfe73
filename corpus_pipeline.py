"""From raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir): quality filter, near-duplicates, repeated passages, benchmark
passages, packing. Every stage works on all that the one before kept; its result is written as Parquet and read again
before the next begins. All but the last return the columns of ``documents``, further columns included, whatever their names.

Odd rows have a defined fate. Null and empty texts and texts without words pass every filter: they score what the constant
scores, are near nothing, hold no passage and no benchmark item, and are packed as one end token. Null ids are kept like
others; of near-duplicates the smallest id stays, null ids come last, and of equal rows one stays. Empty tables give an
empty result; without labels every document scores 0.5 and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import quality
from tidegrid.llm.common import stored
from tidegrid.llm.decontaminate import without_benchmark
from tidegrid.llm.neardup import one_of_each
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.queries import fold, table
from tidegrid.llm.substring import without_repeats

LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more); repeated rows stay repeated.

    It learns from the labels of these documents, without those kept apart for measuring it (every fifth by checksum).
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    scored = quality.score(docs, weights, keep=docs.columns, into="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; ties and nulls as said above."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that occur more than once; n_chars follows the text.

    A document that loses all its words stays, with an empty text.
    """
    cleaned = without_repeats(docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window near a benchmark item; null items count for nothing."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised documents in sequences of at most 4096 tokens, a row per piece; repeated rows are packed each."""
    return pack_documents(docs, give_back=True)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: trained weights and tokens cannot be written in SQL; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
