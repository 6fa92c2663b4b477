"""Operator 6, SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits. Bits that vary together are put into the same
partition, and each partition gets its own threshold: if two fingerprints differ
in at most ``tau`` bits, then some partition i differs in at most ``t_i`` bits,
as long as the thresholds sum to ``tau - m + 1`` (a threshold of -1 leaves a
partition out). A dynamic programme chooses the thresholds of the least
estimated cost. Each distinct fingerprint is probed with all keys within ``t_i``
bits of its own in partition i; what meets in a bucket is verified on all bits.

Exact copies are one row before any pair is looked at. A bucket above
``block`` rows is dealt out as pairs of blocks, and a task returns at most a
spanning forest of what it has verified, so that neither memory nor output grows
with the square of a group. Every link is found, whatever the size of a bucket.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, joined_by, one_batch, removed, sorted_groups, tune, words, written
from .components import components

BITS, SEED, SHINGLE, TAU = 64, 42, 4, 4
#: Rows of a bucket that one task compares with one another.
BLOCK = 2048
#: Cost of a shuffled key, in verified pairs; bits whose values are counted together.
KEY_COST, COUNTED = 150.0, 12


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    w = words(text)
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return majority(np.array([digest(join(w[i : i + shingle]), SEED) for i in range(max(1, len(w) - shingle + 1))], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that over half the hashes ``h`` have; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty, so its fingerprint is zero; a null id stays null."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, how many have each bit, and each pair of bits: 64 x 64 counts, whatever the number of rows."""
    out = pa.schema([("i", pa.int32()), ("c", pa.list_(pa.int64()))])

    def run(batches):
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).round().astype(np.int64)
            n += len(bits)
        if n:
            yield one_batch(out, i=[*range(BITS), BITS], c=[*total.tolist(), [n] + [0] * (BITS - 1)])

    counted = fps.select("fp").mapInArrow(run, "i int, c array<long>").select("i", F.posexplode("c").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS + 1, BITS))
    for i, j, n in counted.collect():
        both[i, j] = n
    return int(both[BITS, 0]), np.diag(both[:BITS]).copy(), both[:BITS]


def bit_partitions(n: int, ones: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size, of bits that correlate most with one another."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _blocks(group: list[int]) -> list[tuple[int, ...]]:
    """The bits of a group in blocks of at most COUNTED, of about equal size."""
    k = -(-len(group) // COUNTED)
    return [tuple(group[len(group) * i // k : len(group) * (i + 1) // k]) for i in range(k)]


def key_counts(fps: DataFrame, blocks: list[tuple[int, ...]]) -> dict[tuple[int, ...], np.ndarray]:
    """How often each value of each block's bits occurs among all ``fps`` (fp): 2**COUNTED numbers a block, whatever the number of rows."""
    out = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = [np.zeros(1 << len(b), dtype=np.int64) for b in blocks]
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, bits in enumerate(blocks):
                total[k] += np.bincount(_gather(f, list(bits)).astype(np.int64), minlength=len(total[k]))
        for k, n in enumerate(total):
            if n.any():
                yield one_batch(out, block=[k], counts=[n.astype("<i8").tobytes()])

    def add(batches):
        total: dict = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, "<i8")
        for k, n in total.items():
            yield one_batch(out, block=[k], counts=[n.tobytes()])

    ddl = "block int, counts binary"
    found = {blocks[r.block]: np.frombuffer(bytes(r.counts), "<i8") for r in fps.select("fp").mapInArrow(run, ddl).repartition("block").mapInArrow(add, ddl).collect()}
    return {b: found.get(b, np.zeros(1 << len(b), dtype=np.int64)) for b in blocks}


def distances(counts: np.ndarray) -> np.ndarray:
    """Shares of the pairs of counted keys that differ in 0, 1, ... bits: the counts' autocorrelation under exclusive or, by two Walsh-Hadamard transforms."""
    width = int(len(counts)).bit_length() - 1

    def transform(x):
        for k in range(width):
            x = x.reshape(-1, 2, 1 << k)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
        return x

    share = counts / max(1, counts.sum())
    both = transform(transform(share.astype(np.float64)) ** 2) / len(counts)
    return np.bincount(np.bitwise_count(np.arange(len(counts))), weights=np.maximum(both, 0), minlength=width + 1)


def choose_plan(fps: DataFrame, tau: int = TAU, key_cost: float = KEY_COST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for ``fps`` (fp): the cheapest over numbers of partitions and, by dynamic programming, over thresholds.

    What a threshold costs is estimated from counted keys of the partition's bits, so
    that bits which vary together aren't taken for independent ones; only blocks of
    COUNTED bits are taken to be independent of one another. No rows give no plan.
    """
    n, ones, both = bit_statistics(fps)
    if not n:
        return []
    partitions = [bit_partitions(n, ones, both, m) for m in range(2, tau + 2)]
    counts = key_counts(fps, list(dict.fromkeys(b for groups in partitions for g in groups for b in _blocks(g))))
    near = {b: distances(c) for b, c in counts.items()}
    best = None
    for m, groups in enumerate(partitions, 2):
        cost = []
        for g in groups:
            share = np.ones(1)  # of pairs that differ in so many bits of the group
            for b in _blocks(g):
                share = np.convolve(share, near[b])
            within = np.cumsum(share)
            cost.append([0.0] + [key_cost * sum(comb(len(g), k) for k in range(t + 1)) + n * within[min(t, len(within) - 1)] for t in range(tau + 1)])
        total = tau - m + 1
        state = {0: (0.0, ())}  # sum of (t_i + 1) so far -> cost, thresholds
        for c in cost:
            new: dict = {}
            for s, (v, ts) in state.items():
                for t in range(-1, tau + 1):
                    if s + t + 1 <= total + m and v + c[t + 1] < new.get(s + t + 1, (np.inf,))[0]:
                        new[s + t + 1] = (v + c[t + 1], (*ts, t))
            state = new
        v, ts = state[total + m]
        if best is None or v < best[0]:
            best = (v, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, moved together."""
    key = np.zeros(len(fps), dtype=np.uint64)
    for at, b in enumerate(bits):
        key |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
    return key


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with the components of the pairs x, y over 0..n-1."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def closest(x: np.ndarray, y: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the linked rows x, y of ``fp`` two links for each row at most: with the smallest fingerprint and with the nearest one."""
    n = len(fp)
    order = np.argsort(fp)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    low, near = np.full(n, n), np.full(n, n * (BITS + 1))
    for a, b in ((x, y), (y, x)):
        np.minimum.at(low, a, rank[b])
        np.minimum.at(near, a, np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64) * n + rank[b])
    row = np.flatnonzero(low < n)
    return np.r_[row, row], order[np.r_[low[row], near[row] % n]]


def _linked(left: np.ndarray, right: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    step = max(1, (1 << 22) // max(len(right), 1))
    for i in range(0, len(left), step):
        r, c = np.nonzero(np.bitwise_count(left[i : i + step, None] ^ right[None, :]) <= tau)
        rows.append(r + i)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], tau: int = TAU, block: int = BLOCK, forest: bool = True) -> DataFrame:
    """(a, b): a spanning forest of each bucket's pairs within ``tau`` bits, over ``distinct`` (fp). No linked pair is in two trees once all buckets are joined.

    Edges of a forest lead to the root of a tree, which may be farther away. Without
    ``forest`` there are linked pairs instead, those of closest() in each bucket.
    """
    probes = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])

    def keys(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part, (bits, t) in enumerate(plan):
                key = _gather(fps, bits)
                for k in range(t + 1):
                    for flip in itertools.combinations(range(len(bits)), k):
                        mask = np.uint64(sum(1 << f for f in flip))
                        n = len(fps)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array((key ^ mask).view(np.int64)), b.column(0), pa.array(np.full(n, k > 0))], schema=probes)

    rows = distinct.select("fp").mapInArrow(keys, "part int, key long, fp long, probe boolean")
    big = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        rows.join(big, ["part", "key"], "left")
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "probe", "own")
        .repartition("part", "key", "i", "j")
        .sortWithinPartitions("part", "key", "i", "j")
    )
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        for t in sorted_groups(batches, 4):
            part, key, i, j, fp, probe, own = (t.column(k).to_numpy() for k in range(7))
            cut = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            a, b = [], []
            for lo, hi in zip(cut, np.r_[cut[1:], len(part)]):
                if hi - lo < 2:
                    continue
                r, p, o = fp[lo:hi], probe[lo:hi], own[lo:hi]
                f = r.view(np.uint64)
                held = np.flatnonzero(~p)  # those whose own key this is
                if not len(held):
                    continue
                if i[lo] == j[lo]:
                    pairs = [(np.arange(hi - lo), held)]
                else:
                    first, second = np.flatnonzero(o == i[lo]), np.flatnonzero(o == j[lo])
                    pairs = [(first, second[~p[second]]), (second, first[~p[first]])]
                for left, right in pairs:
                    if not len(left) or not len(right):
                        continue
                    x, y = _linked(f[left], f[right], tau)
                    x, y = left[x], right[y]
                    near = r[x] != r[y]
                    if near.any():
                        x, y = _forest(x[near], y[near], hi - lo) if forest else closest(x[near], y[near], r)
                        a.append(r[x])
                        b.append(r[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=edge)

    return dealt.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable by links of at most ``tau`` bits.

    Null texts count as empty; a text without words has fingerprint zero and is
    linked like any other. Rows with a null id keep it; their component is the
    smallest id among what they are linked with, null if there is none. Repeated
    rows are all returned. Other columns are ignored. No rows give no rows.
    """
    tune(docs.sparkSession)
    fps = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    chosen = choose_plan(distinct, tau)
    if not chosen:
        return fps.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    edges = links(distinct, chosen, tau, block)
    found = components(edges)
    linked = distinct.join(found, distinct.fp == found.node).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id")
    classes = written(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return joined_by(fps, classes, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that near_duplicates() leaves: of each component the one with the smallest id, the first row of it if an id repeats."""
    kept = near_duplicates(docs).where("doc_id = component_id or component_id is null").select("doc_id").distinct()
    rows = docs.join(kept.hint("shuffle_hash"), docs.doc_id.eqNullSafe(kept.doc_id), "left_semi")
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id"]) if twice else rows


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
