"""What the driver of the pipeline has to hold: memory of training, and plans and jobs of a small graph."""

import tracemalloc

import numpy as np
import pytest

from siltstone.llm import components, quality


def test_memory_of_training():
    """As many rows as are ever learnt from; with the differences of all pairs at once it was 189 MiB."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(quality.SAMPLE, 22))
    label = (x[:, 0] + x[:, 3] + rng.normal(size=len(x)) > 0).astype(int)
    tracemalloc.start()
    r = quality.Ranker(x, label)
    most = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert most < 100
    assert ((r.score(x) >= quality.CUT) == (label == 1)).mean() > 0.7
    # The same steps over all differences at once.
    z = (np.stack([c for k, v in enumerate(x.T) for c in (v, *(np.maximum(v - q, 0) for q in r.knots[k]))], axis=1) - r.mean) / r.sd
    draw = np.random.default_rng(quality.SEED)
    d = z[draw.choice(np.flatnonzero(label == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(label == 0), quality.PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    assert np.allclose(r.w, w, rtol=0, atol=1e-9)


def edges_of(kind):
    rng = np.random.default_rng(8)
    if kind == "path":
        order = rng.permutation(200)
        return list(zip(order[:-1].tolist(), order[1:].tolist()))
    if kind == "none":
        return []
    some = rng.integers(-(2**62), 2**62, 150)
    return [*((int(a), int(b)) for a, b in rng.choice(some, (110, 2))), (int(some[0]), int(some[0])), (None, int(some[1])), (int(some[2]), None)] * 2


def plain(edges):
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["path", "random", "none"])
@pytest.mark.parametrize("bound", [0, None])
def test_components(spark, kind, bound):
    edges = edges_of(kind)
    df = spark.createDataFrame(edges, "a long, b long")
    rows = (components.components(df) if bound is None else components.components(df, bound)).collect()
    assert {r.node: r.component for r in rows} == plain(edges) and len(rows) == len(plain(edges))


def test_jobs_of_a_small_graph(spark):
    """Each job is a plan that the driver keeps, and a task for each partition; the steps took six jobs and more a round."""
    df = spark.createDataFrame(edges_of("path"), "a long, b long")
    spark.sparkContext.setJobGroup("components", "")
    try:
        components.components(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 6
