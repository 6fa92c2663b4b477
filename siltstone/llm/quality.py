"""Operator 5, quality by Bradley-Terry pairwise ranking.

A text's features are counts of its bytes and words, bent into piecewise linear
functions at the quantiles of the training rows. Pairs of a good and a bad
document give logistic loss on the difference of their features; Newton steps
minimise it. The document score is the strength so learnt. The threshold is a
quantile of the training scores, the one that separates the labels best, and the
score in 0..1 is a logistic curve that has 0.7 there.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, crc_of_id, table, tune, written

#: Labelled rows to learn from at most (those of the least seeded hash), and pairs; pairs whose differences are held at once.
SAMPLE, PAIRS, SEED, HELD = 20_000, 60_000, 5, 4096
FOLDS, HELD_OUT, CUT = 4, 2, 0.7
RIDGE = 1e-2

_CLASS = np.zeros(256, dtype=np.int64)
for _set, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" ", 4), (b"\n", 5), (b".,;:'\"()-?", 6), (b"!", 7), (b"*#$%&@^~", 8), (b"|<>{}[]\\/=_+`", 9)):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 10
_CLASS[[*range(9), *range(11, 32), 127]] = 11


def features(text: bytes) -> list[float]:
    """Numbers that don't depend on language or topic; zeros for an empty text."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * 22
    size = len(text)
    kind = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=12) / size
    counts = Counter(w)
    low = np.array([len(x) for x in w])
    many = np.array(list(counts.values()))
    pairs = Counter(zip(w, w[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, w)) / n
    caps = sum(map(bytes.istitle, w)) / n
    same = sum(map(bytes.__eq__, w, w[1:])) / n
    top = int(many.max())
    return [
        float(np.log1p(n)), float(low.mean()), float(low.std()), float(low.max() > 30), upper, caps, same,
        len(counts) / n, float(np.log(len(counts)) / np.log(n + 1.0)), top / n, float((many > 1).mean()),
        1 - len(pairs) / max(1, n - 1), float(np.log1p(max(pairs.values(), default=0))), 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        *(float(kind[k]) for k in (3, 6, 7, 8, 9, 10, 11)),
    ]


class Ranker:
    """Strengths of documents from preference pairs."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = SEED):
        self.knots = [np.unique(np.quantile(c, (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98))) for c in x.T]
        self.mean, self.sd = 0.0, 1.0
        z = self._bend(x)
        self.mean = z.mean(axis=0)
        self.sd = np.array([c.std() for c in z.T]) + 1e-6
        z -= self.mean
        z /= self.sd
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        self.w = np.zeros(z.shape[1])
        if len(good) and len(bad):
            rng = np.random.default_rng(seed)
            first, second = rng.choice(good, pairs), rng.choice(bad, pairs)
            for _ in range(12):
                bend, rise = np.zeros((len(self.w), len(self.w))), np.zeros(len(self.w))
                for k in range(0, pairs, HELD):
                    d = z[first[k : k + HELD]]
                    d -= z[second[k : k + HELD]]
                    p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))
                    rise += d.T @ p
                    bend += (d * (p * (1 - p))[:, None]).T @ d
                step = np.linalg.solve(bend / pairs + RIDGE * np.eye(len(self.w)), rise / pairs - RIDGE * self.w)
                self.w += step
                if np.abs(step).max() < 1e-4:
                    break
        s = z @ self.w
        self.cut, self.scale = self._quantile(s, label), max(1e-6, float(s.std()))
        self.quantile = float((s < self.cut).mean()) if len(s) else 0.0

    def _bend(self, x: np.ndarray) -> np.ndarray:
        z, at = np.empty((len(x), sum(1 + len(q) for q in self.knots))), 0
        for k, v in enumerate(x.T):
            z[:, at] = v
            for j, q in enumerate(self.knots[k], at + 1):
                z[:, j] = np.maximum(v - q, 0)
            at += 1 + len(self.knots[k])
        z -= self.mean
        z /= self.sd
        return z

    @staticmethod
    def _quantile(s: np.ndarray, label: np.ndarray) -> float:
        """The score quantile that gets most labels right, counting both labels alike; of equal ones the middle."""
        if not (label == 1).any() or not (label == 0).any():
            return -np.inf if (label == 1).any() else np.inf
        order = np.argsort(s, kind="stable")
        bad = np.cumsum(label[order] == 0) / (label == 0).sum()
        good = np.cumsum(label[order] == 1) / (label == 1).sum()
        gain = bad - good
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        k = int(best[len(best) // 2])
        return float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self._bend(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; CUT at the threshold."""
        if not np.isfinite(self.cut):
            return np.full(len(x), 1.0 if self.cut < 0 else 0.0)
        return 1 / (1 + np.exp(-np.clip(4 * (self.strength(x) - self.cut) / self.scale + np.log(CUT / (1 - CUT)), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, sample: int, seed: int) -> DataFrame:
    """(text, label, draw) of the labelled rows outside the held-out fold: all, or the ``sample`` of them with the least ``draw``, a seeded hash of id, label and text. Ids that are repeated, or have both labels, are rows of their own."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(folds)) != held_out)).select("doc_id", F.col(column).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "label").limit(sample)  # so few rows fit a broadcast
    draw = F.xxhash64(F.lit(seed), "doc_id", "label", "text").alias("draw")
    rows = written(docs.select("doc_id", bytes_of().alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label", draw), "labelled")  # documents are read once for it
    first = rows.select("draw").orderBy("draw").limit(sample + 1).collect()  # repeated ids may give more rows than labels
    if len(first) <= sample:
        return rows
    cut = first[sample].draw  # rows of one draw are equal: all or none of them, but some where there is nothing else
    return rows.where(F.col("draw") < cut) if first[0].draw < cut else rows.where(F.col("draw") == cut).limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Features are made where the texts are; at most ``sample`` rows of 22 numbers come to the driver, as bytes."""
    out = pa.schema([("label", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([np.array(features(t.as_py()), dtype="<f8").tobytes() for t in b.column(0)], pa.binary())], schema=out)

    rows = labelled(docs, labels, "quality", FOLDS, HELD_OUT, sample, SEED)
    got = rows.select("text", "label").mapInArrow(run, "label int, x binary").collect()
    if not got:
        return Ranker(np.zeros((1, 22)), np.ones(1, dtype=int))
    x, y = np.frombuffer(b"".join(r.x for r in got), "<f8").reshape(len(got), 22), np.array([r.label for r in got], dtype=int)
    order = np.lexsort((*x.T[::-1], y))  # by label, then by the numbers from the first on
    return Ranker(x[order], y[order])


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(ranker)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = sent.value.score(np.array([features(t.as_py()) for t in b.column(2)]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], schema=out)

    held = F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), bytes_of().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Null and empty texts have the features zero and get their score; a null id is
    in the fold of the empty text. Labels other than 0 and 1, or without a
    document, teach nothing; without any label every score is 1. Repeated rows are
    all scored. Other columns are ignored. No rows give no rows.
    """
    tune(docs.sparkSession)
    return scored(docs, train(docs, labels))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, with all their columns. Nulls, repeated rows, empty texts and tables as in quality(); rows of one text are judged alike, and with labels of one kind only that kind is predicted."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        for b in batches:
            if b.num_rows:
                s = sent.value.score(np.array([features(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]))
                yield b.filter(pa.array(s >= CUT))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
