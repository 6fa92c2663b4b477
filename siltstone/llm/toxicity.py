"""Operator 8, toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts common subsequences of ``P`` characters, each weighted by
``DECAY`` to the power of the characters it spans, with gaps of at most ``GAP``
at each step; so an insult with inserted or missing characters stays near to
itself. Words are marked at both ends and the kernel is normalised. A run of
single characters is one word ("s t u p i d").

Sentences take their document's label; the word of a sentence that is judged most
toxic stands for it, as in multiple-instance learning: train, choose each
sentence's word anew, train again. Nyström landmarks are words of the training
sentences, and the machine's examples are the words that stand for labelled sentences.
As the kernel is a scalar product of subsequence weights, the machine over landmarks
folds into one table of weights by hashed subsequence, and a word is judged by summing
its own subsequences, in numpy batches; each worker remembers words that it has judged.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, crc_of_id, table, tune
from .quality import labelled

P, GAP, DECAY = 3, 2, 0.6
#: Labelled documents to learn from at most (those of the least seeded hash), their bytes together, their words, and landmarks.
SAMPLE, BYTES, WORDS, LANDMARKS, SEED = 5_000, 32 << 20, 12_000, 240, 8
#: Share of its documents that a suspect has from toxic ones at least, and rounds of training.
LEAN, ROUNDS = 0.6, 3
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
TABLE = 1 << 21
#: Words whose decisions a worker remembers.
MEMO = 400_000
#: Characters of a word that are judged at once; a longer one is cut into overlapping pieces.
LONG, OVERLAP = 48, 16
_STEPS = [(a, b) for a in range(1, GAP + 2) for b in range(1, GAP + 2)]
_SPACED = re.compile(rb"(?<!\S)\S(?:[ \t]+\S(?!\S)){3,}")
_EDGE = ".,;:!?\"'()[]{}<>*&%$#|-_"
_DROP = {ord(c): None for c in _EDGE}
SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, runs of single characters joined."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: b"".join(m[0].split()), text)
    return text.split()


def strings(word: bytes) -> list[str]:
    """A word without punctuation at its ends, marked, in pieces of at most LONG characters; one with punctuation inside also without it."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGE)
    if len(w) <= LONG:
        bare = w.translate(_DROP)
        return [f"^{x}$" for x in dict.fromkeys((w, bare)) if x]
    return [f"^{w[i : i + LONG]}$" for i in range(0, len(w) - OVERLAP, LONG - OVERLAP)]


def subsequences(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed subsequence, weight) as matrices, a row for each string; weight 0 where there is none."""
    width = max(map(len, batch), default=0)
    codes = np.zeros((len(batch), width + 2 * (GAP + 1)), dtype=np.int64)
    joined = np.frombuffer("".join(batch).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.array([len(s) for s in batch])
    rows = np.repeat(np.arange(len(batch)), size)
    codes[rows, np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)] = joined
    hashes, weights = [], []
    first = codes[:, :width]
    for a, b in _STEPS:
        second, third = codes[:, a : a + width], codes[:, a + b : a + b + width]
        h = (first * 0x9E3779B1 + second * 0x85EBCA77 + third * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
        hashes.append((h ^ (h >> 15) ^ (h >> 29)) & (TABLE - 1))
        weights.append(np.where((first > 0) & (second > 0) & (third > 0), DECAY ** (a + b + 1 - P), 0.0))
    return np.concatenate(hashes, axis=1), np.concatenate(weights, axis=1)


def _norms(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Square root of each string's kernel with itself, equal subsequences summed."""
    order = np.argsort(h, axis=1, kind="stable")
    h, w = np.take_along_axis(h, order, 1), np.take_along_axis(w, order, 1)
    new = np.ones(h.shape, dtype=bool)
    new[:, 1:] = h[:, 1:] != h[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    total = np.bincount(group, weights=w.ravel()) ** 2
    row = (np.flatnonzero(new.ravel())) // h.shape[1]
    return np.sqrt(np.bincount(row, weights=total, minlength=len(h))) + 1e-9


def kernel(left: list[str], right: list[str], step: int = 512) -> np.ndarray:
    """The normalised kernel of all pairs, for a bounded number of ``right`` strings: matrix products over the subsequences that these have."""
    h, w = subsequences(right)
    w = w / _norms(h, w)[:, None]
    used, column = np.unique(h, return_inverse=True)
    place = np.full(TABLE, len(used), dtype=np.int64)
    place[used] = np.arange(len(used))
    wide = len(used) + 1  # the last column takes what no right string has
    other = np.bincount((np.arange(len(right))[:, None] * wide + column.reshape(h.shape)).ravel(), weights=w.ravel(), minlength=len(right) * wide).reshape(len(right), wide).astype(np.float32)
    other[:, -1] = 0
    out = np.zeros((len(left), len(right)))
    for k in range(0, len(left), step):
        h, w = subsequences(left[k : k + step])
        w = w / _norms(h, w)[:, None]
        own = np.bincount((np.arange(len(h))[:, None] * wide + place[h]).ravel(), weights=w.ravel(), minlength=len(h) * wide).reshape(len(h), wide).astype(np.float32)
        out[k : k + step] = own @ other.T
    return out


class Machine:
    """A linear machine over Nyström features of words, folded into one table; and the curve from a document's words to 0..1."""

    def __init__(self):
        self.weights, self.bias = np.zeros(TABLE, dtype=np.float64), 0.0
        self.curve = np.zeros(5)
        self.shift = 0.0
        self.constant: float | None = None
        self.memo: dict[bytes, float] = {}

    def words(self, batch: list[str], step: int = 2048) -> np.ndarray:
        """The decision on each marked string."""
        out = np.zeros(len(batch))
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for k in range(0, len(order), step):
            own = order[k : k + step]
            h, w = subsequences([batch[i] for i in own])
            out[own] = (self.weights[h] * w).sum(axis=1) / _norms(h, w)
        return out + self.bias

    def remember(self, ws: set[bytes]) -> dict[bytes, float]:
        """The decision on each word, the greatest over its strings; a word is judged once while it is remembered."""
        if len(self.memo) + len(ws) > MEMO:
            self.memo = {}
        new = [w for w in ws if w not in self.memo]
        parts = [strings(w) for w in new]
        value = np.full(len(new), -2.0)
        if new:
            np.maximum.at(value, np.repeat(np.arange(len(new)), [len(p) for p in parts]), self.words([s for p in parts for s in p]))
        self.memo |= zip(new, value.tolist())
        return self.memo

    def judge(self, texts: list[bytes]) -> np.ndarray:
        """[greatest decision, second, share and number of words above 0] of each text."""
        lists = [tokens(t) for t in texts]
        memo = self.remember({w for ws in lists for w in ws})
        out = np.full((len(texts), 4), -2.0)
        out[:, 2:] = 0
        for i, ws in enumerate(lists):
            if ws:
                v = np.fromiter(map(memo.__getitem__, ws), np.float64, len(ws))
                hot = int((v > 0).sum())
                top = np.partition(v, -2)[-2:] if len(v) > 1 else np.array([-2.0, v[0]])
                out[i] = top[1], top[0], hot / len(v), np.log1p(hot)
        return out

    def score(self, judged: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(judged), self.constant)
        return 1 / (1 + np.exp(-np.clip(_design(judged) @ self.curve + self.shift, -30, 30)))


def _design(judged: np.ndarray) -> np.ndarray:
    return np.column_stack([judged[:, :2], np.minimum(judged[:, 2] * 20, 1), judged[:, 3], np.ones(len(judged))])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by damped Newton steps; the weights of each label sum to one."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        on = y * (z @ w) < 1
        a = z[on] * weight[on][:, None]
        new = np.linalg.solve(a.T @ z[on] + ridge * np.eye(len(w)), a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = w + (new - w) * 0.9
    return w[:-1], float(w[-1])


def _sure(a: int, b: int, rate: float, chances: int) -> bool:
    """Whether ``a`` toxic documents of ``a + b`` are more than chance gives anywhere among so many words: Chernoff's bound at the rate of toxic documents."""
    n = a + b
    share = a / n
    if share < max(LEAN, rate):
        return False
    gain = share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if b else 0.0)
    return n * gain >= math.log(chances) + 2


def _suspects(bad: Counter, fine: Counter, rate: float) -> dict[str, int]:
    """Words that stand mostly in toxic documents, by themselves or by a beginning that they share; with the number of such documents."""
    stems: tuple[Counter, Counter] = (Counter(), Counter())
    for found, stem in zip((fine, bad), stems):
        for w, n in found.items():
            for k in range(4, min(len(w), 9)):
                stem[w[:k]] += n
    words = len(set(bad) | set(fine))
    good = {s for s, n in stems[1].items() if _sure(n, stems[0][s], rate, len(stems[1]))}
    out = {w: n for w, n in bad.items() if _sure(n, fine[w], rate, words) or (n > fine[w] and any(w[:k] in good for k in range(4, min(len(w), 9))))}
    return out or {w: bad[w] for w in sorted(bad, key=lambda w: (fine[w] - bad[w], w))[:10]}


def distinct(texts: list[bytes]) -> list[bool]:
    """Whether each text is the first of its near copies: those that share four least hashes of their words in one of four bands."""
    seen: set[tuple] = set()
    out = []
    for text in texts:
        h = np.array([zlib.crc32(w) for w in set(text.lower().split())] or [0], dtype=np.uint64)
        least = [int(((h * np.uint64(2 * k + 0x9E3779B1)) >> np.uint64(7) & np.uint64(0xFFFFFFFF) ^ np.uint64(k * 0x5BD1E995 & 0xFFFFFFFF)).min()) for k in range(16)]
        keys = [(k, *least[4 * k : 4 * k + 4]) for k in range(4)]
        out.append(not any(k in seen for k in keys))
        seen.update(keys)
    return out


def learn(rows: list[tuple[bytes, int]], seed: int = SEED) -> Machine:
    """A machine from (text, label)."""
    m = Machine()
    labels = np.array([y for _, y in rows], dtype=int)
    if not (labels == 1).any() or not (labels == 0).any():
        m.constant = float(labels.max(initial=0))
        return m
    rng = np.random.default_rng(seed)
    sentences = []  # (document, marked words) of each sentence
    found: tuple[Counter, Counter] = (Counter(), Counter())
    cut: dict[bytes, list[str]] = {}
    first = distinct([text for text, _ in rows])
    for d, (text, y) in enumerate(rows):
        if not first[d]:
            continue
        own = set()
        for s in SENTENCE.split(text):
            ws = list(dict.fromkeys(p for w in tokens(s) for p in (cut.get(w) or cut.setdefault(w, strings(w)))))
            if ws:
                sentences.append((d, ws))
                own.update(ws)
        found[y].update(own)
    fine, toxic = found
    rate = max(1, sum(f and y for f, y in zip(first, labels))) / max(2, sum(first) + 1)
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    bad = _suspects(toxic, fine, rate)
    every = sorted(set(fine) | set(toxic))
    others = [w for w, _ in fine.most_common(WORDS // 2) if w not in bad]
    rest = sorted(set(fine) - set(others) - set(bad))
    others += [rest[i] for i in rng.permutation(len(rest))[: WORDS // 4]]
    for _ in range(ROUNDS):
        suspects = sorted(bad, key=lambda w: (-bad[w], w))[: WORDS // 4]
        landmarks = suspects[: LANDMARKS // 2] + [others[i] for i in rng.permutation(len(others))[: LANDMARKS // 2]]
        zz = kernel(landmarks, landmarks)
        value, vector = np.linalg.eigh(zz)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        words = suspects + others
        y = np.r_[np.ones(len(suspects)), -np.ones(len(others))]
        weight = np.r_[np.full(len(suspects), 0.5 / max(1, len(suspects))), np.full(len(others), 1.0 / max(1, len(others)))]
        w, bias = _svm(kernel(words, landmarks) @ root, y, weight)
        dense = np.zeros(TABLE, dtype=np.float32)
        for a, s in zip(root @ w, landmarks):
            h, v = subsequences([s])
            np.add.at(dense, h[0], a * v[0] / _norms(h, v)[0])
        m.weights, m.bias, m.memo = dense, bias, {}
        # Each sentence's most toxic word stands for it: what stands for fine ones is learnt as such, what stands for toxic ones joins the insults.
        score = dict(zip(every, m.words(every)))
        chosen = [(labels[d], max(ws, key=score.__getitem__)) for d, ws in sentences]
        worst = Counter(w for y, w in chosen if y == 0)
        again = {w for y, w in chosen if y == 1 and score[w] > 0}
        bad |= {w: toxic[w] for w in again if toxic[w] and _sure(toxic[w], fine[w], rate, len(every))}
        hard = [w for w in worst if score[w] > -0.5 and w not in bad]
        others = list(dict.fromkeys(sorted(hard, key=lambda w: (-score[w], w)) + others))[:WORDS]
    judged = m.judge([t for t, _ in rows])
    x = _design(judged)
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(c)), x.T @ (labels - p) - c)
    m.curve = c
    s = x @ c
    order = np.argsort(s, kind="stable")
    right = np.cumsum(labels[order] == 0) / n0 - np.cumsum(labels[order] == 1) / n1  # by the cut behind each
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(best[len(best) // 2])
    m.shift = float(np.log(CUT / (1 - CUT)) - (s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Machine:
    """Learns from at most ``sample`` labelled rows and ``most`` bytes of text: rows by seeded hash, up to the first that doesn't fit."""
    rows = labelled(docs, labels, "toxic", FOLDS, HELD_OUT, sample, SEED)
    held, last = 0, None
    for r in rows.select("draw", F.octet_length("text").cast("long").alias("size")).orderBy("draw", "size").collect():  # two numbers a row of the sample
        held += r["size"]
        if held > most:
            break
        last = r.draw
    if last is None:
        return learn([])
    kept = rows.where(F.col("draw") <= last).orderBy("draw", "label", "text").limit(sample).collect()
    return learn([(bytes(r.text), r.label) for r in kept])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Null and empty texts have no word and get the score of a text without insults.
    A null id is in the fold of the empty text. Labels other than 0 and 1, or
    without a document, teach nothing; without labels of both kinds every score is
    the only label's (0 if there is none). Repeated rows are all scored. Other
    columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = sent.value.score(sent.value.judge(b.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], schema=out)

    held = F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), bytes_of().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
