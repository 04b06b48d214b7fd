"""Pairs of texts and benchmark items by their rarest seeds, against counts of all shared seeds."""

import random

from pyspark.sql import functions as F

from tickloom.llm import tiling


def test_rarest_seeds_find_all_that_share_enough(spark):
    r = random.Random(5)
    common = list(range(12))  # a passage that all items and texts hold
    items = []
    for i in range(60):
        own = sorted({*common[: r.randint(0, 12)], *(r.randint(100, 400) for _ in range(r.randint(1, 25)))})
        items.append((i, own, r.randint(1, len(own) + 1)))
    texts = [(t, sorted({*common, *(x for _, own, _ in r.sample(items, 2) for x in own if r.random() < 0.7)})) for t in range(400)]
    items_df = spark.createDataFrame(items, "item long, seeds array<long>, least int")
    texts_df = spark.createDataFrame(texts, "text long, seeds array<long>")
    got = {(x["text"], x["item"], x["n"]) for x in tiling._sharing(texts_df, items_df).collect()}
    want = {(t, i, len({*a} & {*b})) for t, a in texts for i, b, least in items if len({*a} & {*b}) >= least}
    assert got == want and len(want) > 400


def test_a_common_passage_brings_no_pairs(spark):
    """Half the seeds of an item, shared by all texts and items, are none of the rarest."""
    common = list(range(10))
    items = spark.createDataFrame([(i, common + [1000 + 10 * i + k for k in range(10)], 11) for i in range(40)], "item long, seeds array<long>, least int")
    rows = tiling._rarest(items)
    assert rows.where(F.col("seed") < 10).count() == 0 and rows.count() == 400


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item long, seeds array<long>, least int")
    texts = spark.createDataFrame([(1, [1])], "text long, seeds array<long>")
    assert tiling._sharing(texts, items).count() == 0 and tiling._sharing(texts.limit(0), items).count() == 0
