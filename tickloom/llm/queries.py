"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, katz, langid, lines, ominhash, packing, pfor, rff, secrets, shards, tiling, vptree, whitening
from .common import shared_dir, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; it is never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, all spans, and how many were found by the battery."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the numbers of its lines in later repeats of runs of 50 words or more, and its text without them."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document by a Katz model of order three, and by the base formula."""
    return katz.score_texts(table(spark, sf_dir, "documents"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, 24 shards of equal row counts, equal texts together where there is room."""
    return shards.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates and text of every document, by their least doc_id."""
    return ominhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold test items, with coverage and tiles."""
    return tiling.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision of every document."""
    return rff.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return vptree.search_table(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to blocks and read back from them."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/tokens"
    pfor.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return pfor.read_tokens(spark.read.schema(pfor.SEGMENTS).parquet(path))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4,096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096)


def op11_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector, by an exact covariance of the distinct ones."""
    return whitening.whiten_table(table(spark, sf_dir, "embeddings"), k=4)


def op12_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by what it adds to each language's compressed text."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op13_rope_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-the-middle form, and of the text that is rebuilt from it."""
    out = infill.restore(infill.infill(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
