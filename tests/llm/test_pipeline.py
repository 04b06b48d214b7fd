"""The pipeline's stages, each on what the one before kept, against plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline as C
import numpy as np

from tickloom.llm import ominhash, queries, rff, tiling
from tickloom.llm.common import staged
from tickloom.llm.words import hashed, lowered

D = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = staged(stage(spark, docs, D), name)
        kept[name] = before, docs
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns, name
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]

    before, out = kept["quality_classifier"]
    scored = rff.classify(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in scored.where("predicted = 1").collect()} and out.count() > 0.7 * len(before)

    before, out = kept["line_dedup"]
    gone = dict(zip(before, brute.line_repeats(list(before.items()), 50, lambda t: 0)))  # ids are unique
    after = {r["doc_id"]: r["text"] for r in out.collect()}
    for d, text in before.items():
        want = "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone[d])
        assert after.get(d) == want or (d not in after and gone[d] and not want.split())

    before, out = kept["minhash_near_dedup"]
    codes = {d: h for d, h in ((d, hashed(lowered([t]))[0]) for d, t in before.items())}
    stay = {r["doc_id"] for r in out.collect()}
    for d in set(before) - stay:  # whoever goes is like an earlier document, perhaps through others
        assert any(e < d for e in before), d
    firsts = sorted(stay)
    for k, a in enumerate(firsts):
        for b in firsts[k + 1 :]:
            both = len(set(codes[a].tolist()) & set(codes[b].tolist())) / max(1, len(set(codes[a].tolist()) | set(codes[b].tolist())))
            if both > 0.9:
                assert not ominhash.similar(*(np.asarray(codes[x]) for x in (a, b)), 0.9), (a, b)

    before, out = kept["benchmark_decontamination"]
    items = {r["item_id"]: hashed(lowered([r["text"]]))[0] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    held = {d for d, t in before.items() for i in items.values() if sum(x[2] for x in tiling.tiles(i, hashed(lowered([t]))[0], 5)) >= 0.6 * len(i)}
    assert {r["doc_id"] for r in out.collect()} == set(before) - held

    before, out = kept["best_fit_packing"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    n = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in before.items()}
    packed = out.toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == n and packed.groupby("sequence_id").length.sum().max() <= 4096
