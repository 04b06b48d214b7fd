"""Texts around one very common word pair: few of their pairs are aligned, and no link is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ominhash
from tickloom.llm.words import hashed


def crowd(n: int, own: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return [" ".join(["so it"] * 150 + [f"w{r.randrange(10**6)}" for _ in range(own)]) for _ in range(n)]


def codes(text: str) -> np.ndarray:
    return (hashed([text.encode()])[0] >> np.uint64(32)).astype("<u4")


def test_texts_around_a_word_pair_are_not_aligned_with_each_other(spark):
    texts = crowd(60, 110)  # 110 of 410 words differ, of which 82 may
    texts += [t.replace(" w1", " v1") for t in texts[:3]]  # links of the last three
    words = spark.createDataFrame([(k, len(codes(t)), codes(t).tobytes()) for k, t in enumerate(texts)], "id long, n_words long, words binary")
    labels = spark.createDataFrame([], "id long, root long")
    waiting = spark.createDataFrame([(b, 0, k) for b in range(20) for k in range(len(texts))], "bucket long, a long, id long")
    found = {tuple(r) for r in ominhash.remaining(waiting, labels, words, 3, 0.8).collect()}
    links = {(a, b) for b in range(len(texts)) for a in range(b) if ominhash.similar(codes(texts[a]), codes(texts[b]), 0.8)}
    assert {(0, 60), (1, 61), (2, 62)} <= links <= found
    assert len(found) <= len(texts)  # 1,953 pairs before


@pytest.mark.parametrize("part", [16, 512])
def test_parts_of_a_group_meet_each_other(spark, monkeypatch, part):
    monkeypatch.setattr(ominhash, "PART", part)
    texts = crowd(40, 60)  # all are similar
    words = spark.createDataFrame([(k, len(codes(t)), codes(t).tobytes()) for k, t in enumerate(texts)], "id long, n_words long, words binary")
    labels = spark.createDataFrame([(k, 0) for k in range(10)], "id long, root long")
    waiting = spark.createDataFrame([(b, b % 2, k) for b in range(6) for k in range(b, len(texts))], "bucket long, a long, id long")
    out = ominhash.remaining(waiting, labels, words, 3, 0.8)
    assert {tuple(r) for r in out.select(F.col("a"), F.col("b")).collect()} == {(a, b) for b in range(10, 40) for a in range(b)}
