"""The pipeline against its stages one after another in plain Python."""

import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers

from siltstone.llm import decontaminate


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mix_to_target_weights", "token_id_output"]
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, sf).toPandas()
    before = set(docs.toPandas().doc_id)
    fine, poor = set(labels[labels.quality == 1].doc_id) & before, set(labels[labels.quality == 0].doc_id) & before
    assert len(fine - set(good.doc_id)) <= 0.05 * len(fine) and len(poor & set(good.doc_id)) <= 0.1 * len(poor)
    kept = spark.createDataFrame(good)
    one = corpus_pipeline.near_dedup_stage(spark, kept, sf).toPandas()
    assert one.columns.tolist() == docs.columns and one.doc_id.is_unique and set(one.doc_id) <= set(good.doc_id)
    clean = corpus_pipeline.decontaminate_stage(spark, spark.createDataFrame(one), sf).toPandas()
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    index = decontaminate.build([(int(i), t.encode()) for i, t in zip(items.item_id, items.text)])
    bad = {i for i, t in zip(one.doc_id, one.text) if decontaminate.search(index, (t or "").encode())}
    assert set(clean.doc_id) == set(one.doc_id) - bad
    mixed = corpus_pipeline.mix_stage(spark, spark.createDataFrame(clean), sf).toPandas()
    assert mixed.columns.tolist() == docs.columns and mixed.doc_id.value_counts().max() <= 3
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    at = 0
    for i, t in sorted(zip(mixed.doc_id, mixed.text)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.token_stage(spark, spark.createDataFrame(mixed), sf).toPandas()
    assert sorted(zip(got.doc_id, got.start, got.n_tokens, got.ids_crc32)) == sorted(want)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns) and out.count() > 0
