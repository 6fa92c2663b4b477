"""Connected components of a large graph by alternating large-star and small-star steps, of a small one in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Edges that one task joins at most: 4 MiB of them.
ALONE = 1 << 18


def _united(batches):
    """(node, component) of all edges of the task, by union and find over places in the sorted nodes."""
    out = pa.schema([("node", pa.int64()), ("component", pa.int64())])
    ends = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches))]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(ends[0])].tolist(), at[len(ends[0]) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # a root is never above its nodes
        root[x] = root[root[x]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], schema=out)


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the smallest node reachable.

    Up to ``alone`` edges between longs go to one task, as each step below costs the
    driver plans and a task for each partition, however few edges there are. Beyond,
    every step is an aggregate with a map-side minimum and a join that Spark can
    split where a hub is skewed; no neighbourhood is gathered in one place. Edges
    with a null end and loops are ignored; repeated edges count once; an empty
    input gives an empty result.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if {kind for _, kind in e.dtypes} == {"bigint"} and e.count() <= alone:
        found = written(e.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
        removed(e)
        return found
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low).distinct()
        old, e = e, written(small, "edges")
        removed(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
