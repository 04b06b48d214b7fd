"""How the Katz scores cut what blocks ask for, and how they sort it."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tickloom.llm import katz


def test_katz_blocks_deal_to_few_buckets_whatever_the_corpus(spark, monkeypatch):
    """Pieces of a block have a cost of their own, so they must not grow with the number of blocks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pieces, blocks = [], []

    def summed(requests, n, fan, *args, of=katz.summed):
        blocks.append(n)
        pieces.append(requests.groupBy("kind").count().agg(F.max("count")).first()[0])
        return of(requests, n, fan, *args)

    whole = sorted(katz.score_texts(docs, block_bytes=8000).collect())
    monkeypatch.setattr(katz, "summed", summed)
    rows = sorted(katz.score_texts(docs, block_bytes=8000, fan=8).collect())
    assert max(blocks) > 32 and max(pieces) <= 2 * 8 * max(blocks), (blocks, pieces)  # buckets are a power of two
    assert rows == whole


@pytest.mark.parametrize("keys", [[], [7], [5, 5, 5], [2**64 - 1, 0, 2**63, 0], list(range(2**63, 2**63 + 3000))[::-1] + [0, 2**64 - 1, 2**63 + 5]])
def test_keys_alike_in_their_first_bits_are_told_apart(keys):
    keys = np.array(keys, "u8")
    kinds, which = katz._distinct(keys)
    want, places = np.unique(keys, return_inverse=True)
    assert (kinds == want).all() and (which == places).all()
    assert (katz._order(keys) == np.argsort(keys, kind="stable")).all()


def test_pieces_come_back_as_they_were():
    r, sizes = np.random.default_rng(3), np.array([3, 0, 1, 500])
    keys = np.concatenate([np.sort(r.integers(0, 2**64, n, "u8")) for n in sizes])
    rows = r.integers(0, 2**32, (len(keys), 10), "u4")
    pieces = katz._cut(sizes, katz._deltas(keys, sizes), rows)
    got, (deltas, back) = katz._joined(pieces, "<u8", "10<u4")
    assert (got == sizes).all() and (katz._risen(deltas, got) == keys).all() and (back == rows).all()
    assert katz._joined([], "<u8", "10<u4")[1][1].shape == (0, 10)
