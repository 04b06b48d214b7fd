"""A training-data pipeline over the documents table: every stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import lines, ominhash, packing, rff, tiling
from tickloom.llm.common import staged, table
from tickloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return rff.accepted(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of line runs of 50 words; ``n_chars`` follows, and texts of which nothing stays go."""
    return lines.without_repeats(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return ominhash.keep_first(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4,096 tokens."""
    return packing.pack(docs, tokenizer_path(), size=4096)


STAGES = [
    ("quality_classifier", quality), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination), ("best_fit_packing", best_fit_packing),
]
#: Learned scores, sketches and tokenizers are not SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
