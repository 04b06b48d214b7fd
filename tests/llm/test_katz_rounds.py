"""What the Katz scores hold on disk at a time."""

import pathlib

from pyspark.sql import functions as F

from tickloom.llm import katz
from tickloom.llm.common import shared_dir


def test_katz_rounds_hold_one_order_of_requests(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before, held, kinds = set(folder.rglob("*.parquet")), [], []

    def staged() -> int:
        return sum(f.stat().st_size for f in set(folder.rglob("*.parquet")) - before)

    def summed(requests, *args, of=katz.summed):
        rows = requests.groupBy("kind").agg(F.sum(F.length("data")).alias("n")).collect()
        kinds.append({r["kind"] for r in rows})
        held.append(staged() + sum(r["n"] for r in rows))
        return of(requests, *args)

    monkeypatch.setattr(katz, "summed", summed)
    out = katz.score_texts(docs, block_bytes=512 << 10)
    held.append(2 * staged())  # all of it goes to the blocks once more
    assert max(held) <= 1.9 * texts, [h / texts for h in held]
    assert kinds == [{1}, {2}, {3}, {katz.MASSES + 2, katz.MASSES + 3}]
    assert not [f for f in set(folder.rglob("*.parquet")) - before if f.parent.name == "blocks"]
    assert out.count() == docs.count()
