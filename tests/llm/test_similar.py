"""The near-duplicate stage of the pipeline against all pairs in plain Python."""

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from siltstone.llm import simhash, similar


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts):
    """The ids that stay, by union over all pairs of similarity 0.8."""
    sets, root = sets_of(texts), list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return set(least.values())


def test_changed_words_are_near(spark):
    """A few changed words: similar by shingles, but more than four bits of the fingerprint apart."""
    base = [f"word{k}" for k in range(300)]
    rows = [(1, " ".join(base), "en", "a"), (9, "quite another text of a few words", "en", "a")]
    for d in range(2, 8):
        w = list(base)
        for k in range(4):
            w[(d * 37 + k * 61) % 300] = f"new{d}x{k}"
        rows.append((d, " ".join(w), "en", "a"))
    far = [w if k % 10 else "far" for k, w in enumerate(base)]
    rows.append((20, " ".join(far), "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, None).collect()}
    assert left == brute([r[0] for r in rows], [r[1] for r in rows]) == {1, 9, 20}


@pytest.mark.parametrize("block", [2048, 2])
def test_all_pairs(spark, docs, texts, block):
    ids = {r.component_id for r in similar.near_duplicates(docs, block).collect()}
    assert ids == brute(texts.doc_id.tolist(), texts.text.tolist())


def test_odd_rows(spark, odd_docs, no_docs):
    out = similar.one_of_each(odd_docs)
    assert out.columns == odd_docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 6, 7, 8, 9]  # 10 has 12 of its 15 shingles from 1
    assert similar.one_of_each(no_docs).count() == 0


def test_repeated_and_missing_ids(spark):
    """Rows of one id with different texts, and different texts without an id, are documents of their own."""
    far = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(5, far(1), "a"), (5, far(2), "b"), (5, far(2), "b"), (None, far(3), "c"), (None, far(4), "d"), (None, far(4), "d"), (None, far(1), "e"), (2, far(4) + " more", "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, hash string")
    left = sorted((r.doc_id or 0, r.text, r.hash) for r in similar.one_of_each(docs).collect())
    assert left == sorted([(5, far(1), "a"), (5, far(2), "b"), (0, far(3), "c"), (2, far(4) + " more", "f")])


def fingerprint_of(shingles):
    """SimHash of a set of shingles, bit by bit."""
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_come_first(spark, monkeypatch):
    """Without the search by shingles the stage still drops what SimHash shows: similar texts whose fingerprints are TAU bits apart at most, and no other."""
    rows = []
    for g in range(12):
        base = [f"g{g}word{k}" for k in range(200)]
        rows.append((10 * g, " ".join(base)))
        for d in range(1, 6):
            w = list(base)
            for k in range(d * d):  # 1 to 25 changed words: from near to far
                w[(g + 5 + k * 7) % 200] = f"new{g}x{d}x{k}"
            rows.append((10 * g + d, " ".join(w)))
    sets = sets_of(t for _, t in rows)
    fps = [fingerprint_of(s) for s in sets]
    gone, similar_pairs = set(), 0
    for i in range(len(rows)):
        for j in range(i):
            alike = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            similar_pairs += alike
            if alike and (fps[i] ^ fps[j]).bit_count() <= similar.TAU:
                gone.add(rows[i][0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in similar.shingle_sets(docs).collect()}
    assert [found[i].fp % 2**64 for i, _ in rows] == fps
    beginnings = similar.beginnings
    monkeypatch.setattr(similar, "beginnings", lambda sets, counts: beginnings(sets.limit(0), counts))
    left = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, None).collect()}
    assert gone and left == {i for i, _ in rows} - gone


@pytest.mark.parametrize("block", [8, 2048])
def test_nearest_fingerprints(spark, block):
    """The generalised pigeonhole search at TAU bits gives each fingerprint its smallest and nearest link, in buckets of any size."""
    rng = np.random.default_rng(5)
    fps = [0]
    for _ in range(400):
        f = fps[int(rng.integers(0, len(fps)))] if rng.random() < 0.5 else int(rng.integers(0, 2**63)) * 2
        for b in rng.choice(64, rng.integers(1, 14), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    f = np.unique(np.array(fps, dtype=np.uint64)).view(np.int64)
    far = np.bitwise_count(f.view(np.uint64)[:, None] ^ f.view(np.uint64)[None]).astype(int) + 65 * np.eye(len(f), dtype=int)
    want = {int(a): (int(d.min()), int(f[d <= similar.TAU].min())) for a, d in zip(f, far) if d.min() <= similar.TAU}
    rows = spark.createDataFrame([(int(x),) for x in f], "fp long")
    plan = simhash.choose_plan(rows, similar.TAU)
    assert sum(t + 1 for _, t in plan) >= similar.TAU + 1  # thresholds sum to tau - m + 1
    got: dict = {}
    for a, b in simhash.links(rows, plan, similar.TAU, block, forest=False).collect():
        got.setdefault(a, []).append(b)
    distance = lambda a, b: ((a ^ b) % 2**64).bit_count()
    assert all(distance(a, b) <= similar.TAU for a in got for b in got[a])
    assert {a: (min(distance(a, b) for b in bs), min(bs)) for a, bs in got.items()} == want
