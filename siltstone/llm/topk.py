"""Operator 10, exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component, set where it is above zero; the
distance is the number of differing bits. A shard of codes is indexed by ``m``
segments. A query looks up its own segments first, then those that differ in one
bit, in two, and so on, a segment at a time: after segment s at radius r, every
code within ``m r + s`` bits has been verified. It stops once its k-th distance is
within that bound, so nothing nearer, and nothing as near, can be missing. Where the
next radius has more keys than the shard has codes, the codes that are left are
verified at once.

Equal codes are one: of each, the k smallest ids are kept, made in every task
before any row moves. Codes are dealt into shards and queries into blocks, both of
bounded size; each pair is a group of its own, whose queries are searched together,
and a query carries its k-th distance from round to round.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import one_batch, removed, table, tune, written

K, BITS, EVERY = 10, 64, 20
#: Codes of a shard and queries of a block at most; shards that a small table is dealt into.
SHARD, QUERIES, SPREAD = 1 << 17, 1 << 14, 16
#: Pairs of a query and a code that are held in memory at once.
CELLS = 1 << 22
#: Tasks that the pairs are dealt to at most; more pairs are done in turn.
TASKS = 20_000


def codes(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, code): code as a signed long. Vectors that are null, or haven't 64 components, have none; a null component counts as zero."""
    out = pa.schema([("id", pa.int64()), ("code", pa.int64())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = pa.compute.fill_null(b.column(1).flatten(), 0.0).to_numpy(zero_copy_only=False)
            bits = np.packbits(flat.reshape(-1, BITS) > 0, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(bits).view("<i8").ravel())], schema=out)

    import pyarrow.compute  # noqa: F401

    ok = vectors.where((F.size(vec) == BITS) & F.col(key).isNotNull())
    return ok.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "id long, code long")


def least_ids(rows: DataFrame, k: int) -> DataFrame:
    """(code, id) with the k smallest ids of each code: first within every task, then of what these give."""
    out = pa.schema([("code", pa.int64()), ("id", pa.int64())])

    def run(batches):
        kept: dict[int, list[int]] = {}
        for b in batches:
            got = pd.DataFrame({"code": b.column(0).to_numpy(), "id": b.column(1).to_numpy()}).drop_duplicates().sort_values(["code", "id"])
            got = got[got.groupby("code").cumcount() < k]
            for c, i in zip(got.code.tolist(), got.id.tolist()):
                kept.setdefault(c, []).append(i)
            if len(kept) > 200_000:
                yield from give(kept)
                kept = {}
        yield from give(kept)

    def give(kept):
        pairs = [(c, i) for c, ids in kept.items() for i in sorted(set(ids))[:k]]
        yield one_batch(out, code=[c for c, _ in pairs], id=[i for _, i in pairs])

    first = rows.select("code", "id").mapInArrow(run, "code long, id long").distinct()
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("code", "id")


@lru_cache(maxsize=256)
def masks(width: int, weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), weight)], dtype=np.int64)


class Shard:
    """Multi-index of distinct codes."""

    def __init__(self, found: np.ndarray, bits: int = BITS):
        self.codes = found.astype(np.uint64)
        n = len(found)
        self.m = max(2, min(8, round(bits / max(1.0, np.log2(max(n, 2))))))
        cuts = [bits * s // self.m for s in range(self.m + 1)]
        self.segments = []
        for a, b in itertools.pairwise(cuts):
            value = self.segment(self.codes, a, b)
            order = np.argsort(value, kind="stable")
            self.segments.append((a, b, order, value[order]))

    @staticmethod
    def segment(x, a: int, b: int):
        return ((x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int, sizes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance) of the codes that hold the k ids nearest to each query, ties included, but none beyond its ``bound``; ``sizes`` is how many ids each code has."""
        step = max(1, CELLS // max(1, len(self.codes)))
        parts = [self._some(queries[lo : lo + step], k, sizes, bound[lo : lo + step], lo) for lo in range(0, len(queries), step)]
        return tuple(np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(3))

    def _some(self, queries: np.ndarray, k: int, sizes: np.ndarray, bound: np.ndarray, first: int):
        """A bounded number of queries at once, each until its k-th distance, or its bound, is within what has been covered."""
        n, live = len(self.codes), np.arange(len(queries))
        seen = np.zeros((len(queries), n), dtype=bool)
        at = np.zeros((len(queries), BITS + 1), dtype=np.int64)  # ids at each distance
        found: list[tuple] = [(np.zeros(0, np.int64),) * 3]

        def verify(q: np.ndarray, p: np.ndarray):
            seen[q, p] = True
            d = np.bitwise_count(self.codes[p] ^ queries[q]).astype(np.int64)
            np.add.at(at, (q, d), sizes[p])
            found.append((q, p, d))

        for r in range(BITS + 1):
            for s, (a, b, order, value) in enumerate(self.segments):
                if r > b - a or not len(live):
                    continue
                probe = masks(b - a, r) if n else np.zeros(0, np.int64)
                if len(probe) * 2 > n:
                    q, p = np.nonzero(~seen[live])
                    verify(live[q], p)
                    live = live[:0]
                    continue
                own = (self.segment(queries[live], a, b)[:, None] ^ probe).ravel()
                lo, hi = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
                size = hi - lo
                p = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                q = np.repeat(np.repeat(live, len(probe)), size)
                new = ~seen[q, p]
                if new.any():
                    verify(q[new], p[new])
                covered = min(self.m * r + s, BITS)
                live = live[(at[live, : covered + 1].sum(axis=1) < k) & (covered < bound[live])]
        q, p, d = (np.concatenate([f[j] for f in found]) for j in range(3))
        sums = np.cumsum(at, axis=1)
        far = np.minimum(np.where(sums[:, -1] >= k, (sums < k).sum(axis=1), BITS), bound)  # the k-th distance, if there are so many
        near = d <= far[q]
        return q[near] + first, p[near], d[near]


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, neighbor_id, distance, rank: the k rows (id, code) nearest to each query (id, code), ties by id. A query that is a row itself finds itself.

    Queries of one code are one. Each begins at a shard of its own and visits the
    others in rounds, as many in each round as before it; its k-th distance so far
    goes with it as a bound, so that a round returns about as many rows as the first.
    Rows and queries without an id or code aren't given; repeated ones count once.
    No rows, or no queries, give no rows.
    """
    held = written(least_ids(rows, k), "codes")
    every = written(queries.distinct(), "queries")
    asked = every.select("code").distinct()
    n, q = held.count(), asked.count()
    shards, blocks = max(min(SPREAD, -(-n // 500)), -(-n // shard), 1), max(1, -(-q // block))
    own = F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int")
    left = held.select(own.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "code", "id")
    start = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(shards))

    def find(codes: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        names = ("code", "neighbor_id", "distance")
        if not len(codes) or not len(asks):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
        codes = codes.sort_values(["code", "id"])
        distinct, start, sizes = np.unique(codes.code.to_numpy(), return_index=True, return_counts=True)
        ids, asked = codes.id.to_numpy(), asks.code.to_numpy()
        which, place, far = Shard(distinct.view(np.uint64)).search(asked.view(np.uint64), k, sizes, asks.bound.to_numpy())
        many = sizes[place]
        who = ids[np.repeat(start[place] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        which, far = np.repeat(which, many), np.repeat(far, many)
        order = np.lexsort((who, far, which))
        which, who, far = which[order], who[order], far[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        return pd.DataFrame(dict(zip(names, (x[rank < k] for x in (asked[which], who, far)))))

    # So many partitions as there are pairs: left to itself, a small input would be merged into one task, though its work isn't small.
    tasks = min(shards * blocks, TASKS)
    rank = F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbor_id"))
    best, done = None, 0
    while done < shards:
        end = min(shards, max(1, 2 * done))
        known = asked.withColumn("bound", F.lit(BITS)) if best is None else asked.join(best.where(F.col("rank") == k).select("code", F.col("distance").alias("bound")), "code", "left").withColumn("bound", F.coalesce("bound", F.lit(BITS)))
        right = known.select("code", F.col("bound").cast("long").alias("bound"), F.pmod(F.xxhash64("code", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(done), F.lit(end - 1))).alias("step"))
        right = right.select(F.pmod(start + F.col("step"), F.lit(shards)).cast("int").alias("shard"), "block", "code", "bound")
        pair = (left.repartition(tasks, "shard", "block").groupBy("shard", "block"), right.repartition(tasks, "shard", "block").groupBy("shard", "block"))
        found = pair[0].cogroup(pair[1]).applyInPandas(find, "code long, neighbor_id long, distance long")
        found = found if best is None else found.unionByName(best.drop("rank"))
        old, best = best, written(found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k), "best")
        if old is not None:
            removed(old)
        done = end
    return every.join(best, "code").select(F.col("id").alias("query_id"), "neighbor_id", "distance", "rank")


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) to each row whose id is divisible by ``every``.

    Rows with a null id, a null vector or one that hasn't 64 components are neither
    asked nor found. Equal ids count once for each different code; a query id with
    several codes gets the k best of all. Other columns are ignored. No rows give
    no rows.
    """
    tune(vectors.sparkSession)
    rows = written(codes(vectors), "vectors")
    return nearest(rows, rows.where(F.col("id") % every == 0), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE len(embedding) = {BITS} AND vec_id IS NOT NULL
), pairs AS (
  SELECT q.id AS query_id, r.id AS neighbor_id, CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM v q, v r WHERE q.id % {EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs
)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= {K}
"""
