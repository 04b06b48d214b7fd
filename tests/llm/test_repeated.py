"""Rows that repeat an id, with the same text or vector or another one, and scores that depend on no layout."""

from __future__ import annotations

import random

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from tickloom.llm import katz, ominhash, rff, tiling, vptree

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "s", "ing")) for _ in range(n))


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_text_of_a_class_stays_whatever_its_id(spark):
    a, b, c = (prose(k, 80) for k in range(3))
    near = b.replace("alpha", "omega", 1) + " more"
    rows = [(3, a), (7, a), (7, b), (9, near), (9, c), (9, c), (None, c), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(ominhash.keep_first(docs)) == sorted([(3, a), (7, b), (9, c), (9, c), (None, c), (None, None), (4, "")], key=str)
    two = spark.createDataFrame([(5, b), (5, near), (6, b)], "doc_id long, text string")
    out = kept(ominhash.keep_first(two))
    assert len(out) == 1 and out[0][0] == 5


def test_decontamination_judges_rows(spark):
    item = prose(50, 40)
    docs = spark.createDataFrame([(1, f"so {item} ends"), (1, prose(51, 60)), (2, prose(52, 60)), (None, item), (None, prose(53, 9)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert kept(tiling.decontaminate(docs, items)) == sorted([(1, prose(51, 60)), (2, prose(52, 60)), (None, prose(53, 9)), (3, None)], key=str)


def test_quality_judges_rows(spark):
    good = [(k, prose(k, 120).capitalize() + ".") for k in range(200)]
    bad = [(k, "!!! $$$ ### 000 " * 30) for k in range(200, 400)]
    labels = spark.createDataFrame([(k, int(k < 200)) for k in range(400) if k % 7], "doc_id long, quality int")
    docs = spark.createDataFrame([*good, *bad, (0, bad[0][1]), (399, good[5][1])], "doc_id long, text string")
    out = kept(rff.accepted(docs, labels))
    assert (0, good[0][1]) in out and (0, bad[0][1]) not in out and (399, good[5][1]) in out and (399, bad[-1][1]) not in out
    assert {r["doc_id"] for r in rff.classify(docs, labels).where("predicted = 1").collect()} >= {k for k, _ in good}


def test_pipeline_stages_keep_texts_of_repeated_ids(spark):
    """The stages between the first and the last lose no text of its own because of another row's id."""
    sf = "/root/testdata/sf0.001"
    rows = [(3, prose(1, 90)), (7, prose(1, 90)), (7, prose(2, 90)), (8, prose(3, 90))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[1:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert [d for d, t in kept(docs)] == [3, 7, 8] and (7, prose(2, 90)) in kept(docs)


def test_repeated_vectors_count_once(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(5, [1.0, 0.0]), (7, [0.5, 0.0]), (7, [0.5, 0.0]), (8, [0.25, 1.0]), (8, [-1.0, 0.0])]
    out = vptree.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=1.0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 5, 1.0), (0, 2, 7, 0.5), (0, 3, 8, 0.25), (0, 4, 8, -1.0)]


@pytest.mark.parametrize("factor", [0.0, 0.05])
def test_small_factors_still_find_neighbours(spark, factor):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(1200)]
    out = vptree.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), factor=factor, shard_rows=300)
    counts = {r["query_id"]: r["n"] for r in out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(counts) == 60 and set(counts.values()) == {20}


def test_katz_scores_do_not_depend_on_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = []
    for parts, size in ((1, 4 << 20), (8, 64 << 10), (3, 17 << 10)):
        out = katz.score_texts(docs.repartition(parts), block_bytes=size, fan=1024 if parts != 3 else 4)
        found.append({r["doc_id"]: (r["n_known"], r["train_tokens"], round(r["score"], 6)) for r in out.collect()})
    assert found[0] == found[1] == found[2]
