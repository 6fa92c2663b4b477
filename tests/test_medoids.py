"""Medoids of labels that have more rows than candidates."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import neighbours
from siltstone.operators.ocr import glyphs


def test_costs_are_of_all_rows(spark):
    """The best candidate by all rows, which the candidates among themselves don't tell."""
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), rng.normal(size=3).tolist()) for i in range(400)] + [(900 + i, None, [float(i), 0.0, 1.0]) for i in range(5)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {(r.label, r.vec_id) for r in neighbours.label_medoids(vectors, 1, 12).collect()}
    hashes = {r.vec_id: r.h for r in vectors.select("vec_id", F.xxhash64(F.lit(neighbours.SEED), "vec_id").alias("h")).collect()}
    want = {(None, 902)}
    for label in (0, 1):
        own = [(i, np.array(v)) for i, m, v in rows if m == label]
        tried = sorted(own, key=lambda r: (hashes[r[0]], r[0]))[:12]
        want.add((label, min(tried, key=lambda c: sum(np.linalg.norm(c[1] - v) for _, v in own))[0]))
    assert got == want
    sampled = {sorted(t for t, _ in tried)[glyphs.medoids(np.stack([v for _, v in sorted(tried, key=lambda r: r[0])]), 1)[0]]}
    assert sampled != {i for m, i in got if m == 1}


def test_same_as_whole_group(spark, sf):
    """With all rows but one as candidates, the medoids cost what those of the whole group do, or hardly more."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").where("label < 2")
    whole, parts = ({r.vec_id for r in neighbours.label_medoids(vectors, 3, n).collect()} for n in (10_000, vectors.groupBy("label").count().agg(F.min("count")).first()[0] - 1))
    pdf = vectors.toPandas()

    def cost(ids):
        return sum(np.sqrt(((np.stack(g.embedding)[:, None] - np.stack(g[g.vec_id.isin(ids)].embedding)[None]) ** 2).sum(axis=2)).min(axis=1).sum() for _, g in pdf.groupby("label"))

    assert len(parts) == 6 and cost(parts) <= cost(whole) * 1.02
