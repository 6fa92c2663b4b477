"""Operator 2, language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

The ``KNOWN`` most frequent training words are outputs of their own; all other words,
those never seen included, fall into ``KEYS`` outputs by their last two bytes, and a
word has its smoothed share of its output, where one unknown word of each counts as
seen once. Outputs fall into ``CLASSES`` by the company they keep: by how often each of
the ``CONTEXTS`` most frequent words was the last such word before them (k-means over
all training tokens). Within a class they form a tree of ever smaller classes,
``WIDE`` to a node, frequent words near its top. An output's probability is the product
of one softmax for each node on its way, so the probabilities of all words and of the
unknown ones sum to one after any history.

The scores of a softmax add up a row of a hashed table for each feature of the history
and the node: the word before, the two words before together, and as a skip feature
the last frequent word. Rare words and long histories thus share what the
classes above them have learnt.

Training is distributed: every learner runs through its texts in sparse numpy batches
and makes AdaGrad updates of its own copy of the table, from the model that all share.
A row's changes are merged by how much gradient each learner has seen in it: means
where there was plenty, more where each saw little. A learner has ``LEARN`` tokens on
average, however many cores there are.

Words are counted over all training texts. Counts of the known words travel with the
model; the others' are joined, as their number grows with the corpus.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, crc_of_id, one_batch, removed, table, task_partition, tune, words, written

FOLDS, HELD_OUT = 7, 2
#: Outputs: known words and keys of other words, 16 bits together. Outputs of a softmax.
KEYS, WIDE = 1 << 10, 16
KNOWN = (1 << 16) - KEYS
CLASSES, CONTEXTS = 16, 64
#: Rows of the hashed table, AdaGrad's step, tokens of a numpy batch, tokens of a learner, rounds that share a model.
ROW_BITS, STEP, BATCH, LEARN, ROUNDS = 19, 1.0, 1 << 12, 1 << 22, 1
ROWS = 1 << ROW_BITS
#: Squared gradient of a row in one learner that counts as plenty; rows of the table, and outputs, that travel together.
PLENTY, PIECE = 10.0, 1 << 10
#: Shares of a step of the count that is too large to be taken whole.
SHARES = 1 << 12
END = b"\n"  # cannot be part of a word
NONE = 1 << 16  # before the text
LN10 = float(np.log(10))


def key_of(word: bytes) -> int:
    return (word[-1] * 40503 + (word[-2] if len(word) > 1 else 0) * 9973) % KEYS


class Ids(dict):
    """Ids of known words; KNOWN + key_of() for any other."""

    def __missing__(self, word: bytes) -> int:
        return KNOWN + key_of(word)


class Vocabulary:
    """The most frequent training words: id is the rank."""

    def __init__(self, ranked: list[tuple[bytes, int]], tokens: int, distinct: int, tails: np.ndarray):
        """``tails``: tokens and distinct words of each key, over all words."""
        self.id = Ids((w, k) for k, (w, _) in enumerate(ranked))
        self.count = np.array([n for _, n in ranked], dtype=np.int64)
        self.tokens, self.distinct = tokens, distinct
        own = np.array([key_of(w) for w, _ in ranked], dtype=np.int64)
        self.tail = tails - np.stack([np.bincount(own, weights=self.count, minlength=KEYS), np.bincount(own, minlength=KEYS)]).astype(np.int64)

    def ids(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.id.__getitem__, ws), dtype=np.uint16, count=len(ws))


def tokens_of(text: bytes) -> list[bytes]:
    out = words(text)
    out.append(END)
    return out


def last_context(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The last frequent word before each token in its text; NONE without one. ``first`` is where the token's text begins."""
    at = np.where((ids < CONTEXTS) & (ids != end), np.arange(len(ids)), -1)
    last = np.maximum.accumulate(np.concatenate([[-1], at[:-1]])) if len(ids) else at
    return np.where(last >= first, ids[last].astype(np.int64), NONE)


def history(ids: np.ndarray, first: np.ndarray, end: int) -> list[np.ndarray]:
    """Hashed features of each token's history."""
    place, before, wide = np.arange(len(ids)), [], ids.astype(np.uint32)
    for k in (1, 2):
        w = np.full(len(ids), NONE, dtype=np.uint32)
        w[k:] = np.where(place[k:] - k >= first[k:], wide[:-k], np.uint32(NONE))
        before.append(w + np.uint32(1))
    skip = last_context(ids, first, end).astype(np.uint32) + np.uint32(1)
    one, two = before
    return [one * np.uint32(0x9E3779B1), (one * np.uint32(0x85EBCA77)) ^ (two * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F), skip * np.uint32(0x165667B1) ^ np.uint32(0x5BD1E995)]


def tree(weights: np.ndarray) -> tuple[int, dict[int, list[int]]]:
    """(root, children of each inner node): Huffman's tree with WIDE children to a node; leaves are 0 .. n - 1, inner nodes follow, -1 is nothing."""
    n = len(weights)
    heap = [(0.0, -1 - k) for k in range(-(n - 1) % (WIDE - 1))] + [(float(w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    children: dict[int, list[int]] = {}
    while len(heap) > 1:
        group = [heapq.heappop(heap) for _ in range(WIDE)]
        node = n + len(children)
        children[node] = [max(k, -1) for _, k in group]
        heapq.heappush(heap, (sum(w for w, _ in group), node))
    return heap[0][1], children


def company(counts: np.ndarray, classes: int = CLASSES, rounds: int = 25) -> np.ndarray:
    """The class of each row of ``counts`` (outputs x contexts), by k-means on square roots of smoothed shares less those of all rows."""
    n, total = counts.sum(axis=1).astype(np.float32), counts.sum(axis=0, dtype=np.float64)
    mean = (total / max(1.0, total.sum())).astype(np.float32)
    x = np.sqrt((counts + 2 * mean) / (n + 2)[:, None]) - np.sqrt(mean)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 1e-9
    weight = np.minimum(n, 1000)
    often = np.argsort(-n, kind="stable")[:2000]
    chosen = [often[0]]
    while len(chosen) < classes:  # the frequent row that is least like those chosen
        chosen.append(often[(x[often] @ x[chosen].T).max(axis=1).argmin()])
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([weight[own == k] @ x[own == k] for k in range(classes)])
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return (x @ centres.T).argmax(axis=1)


class Model:
    """Paths of outputs, biases from counts, and the hashed table."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray):
        """``counts``: how often each context came before each output."""
        v = vocabulary
        self.end = v.id.get(END, -1)
        known = len(v.count)
        self.outputs = np.r_[np.arange(known), KNOWN + np.arange(KEYS)]
        weight = np.r_[v.count, v.tail[0] + 0.5].astype(np.float64)
        own = company(counts[self.outputs])
        paths: list[tuple] = [()] * len(weight)
        nodes = 1  # node 0 has the classes as children
        for c in range(CLASSES):
            members = np.flatnonzero(own == c)
            if len(members) < 2:
                for k in members:
                    paths[k] = ((0, c),)
                continue
            root, children = tree(weight[members])
            held = [(root, ((0, c),))]
            while held:
                node, way = held.pop()
                for j, child in enumerate(children[node]):
                    step = (*way, (nodes + node - len(members), j))
                    if child >= len(members):
                        held.append((child, step))
                    elif child >= 0:
                        paths[members[child]] = step
            nodes += len(children)
        depth = np.array([len(p) for p in paths])
        self.node = np.array([n for p in paths for n, _ in p], dtype=np.int32)
        self.child = np.array([j for p in paths for _, j in p], dtype=np.int32)
        mass = np.bincount(self.node * WIDE + self.child, weights=np.repeat(weight, depth), minlength=nodes * WIDE).reshape(-1, WIDE)
        self.bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)), -60.0).astype(np.float32)
        self.depth, self.start = np.zeros(NONE, dtype=np.int64), np.zeros(NONE, dtype=np.int64)
        self.depth[self.outputs], self.start[self.outputs] = depth, np.cumsum(depth) - depth
        self.hashed = self.node.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.weights = np.zeros((ROWS, WIDE), dtype=np.float32)
        self.square = np.ones(ROWS, dtype=np.float32)
        self.ones = np.ones(WIDE, dtype=np.float32)
        # What is known of each output besides its path: the logarithm of a known word's count and of what the words of a key share.
        seen = np.zeros(NONE)
        seen[:known] = np.log(v.count + 1.0)
        self.seen = seen
        self.shared = np.zeros(NONE)
        self.shared[KNOWN:] = np.log(v.tail[0] + v.tail[1] + 1.0)
        self.least = float(np.log(v.tokens + v.distinct + 1.0))

    def _way(self, ids: np.ndarray, features: list[np.ndarray]):
        """The nodes on the ways of all tokens: token and path element of each, and its hash with each feature."""
        size = self.depth[ids]
        own = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        at = np.arange(len(own)) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        salt, rows = self.hashed[at], []
        for f in features:
            h = (f[own] ^ salt) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            h >>= np.uint32(32 - ROW_BITS)
            rows.append(h)
        return own, at, rows

    def learn(self, ids: np.ndarray, features: list[np.ndarray]) -> None:
        """One AdaGrad step of the batch's summed gradient. Each row of the table is read and written once, in ascending order."""
        _, at, rows = self._way(ids, features)
        p = self.bias.take(self.node[at], axis=0)
        held, places = [], np.arange(len(at), dtype=np.uint64)
        for h in rows:
            packed = h.astype(np.uint64) << np.uint64(32) | places  # row and place in one number: one sort of plain numbers
            packed.sort()
            order, ordered = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), (packed >> np.uint64(32)).astype(np.int64)
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first = np.flatnonzero(new)
            used = ordered[first]
            weights = self.weights.take(used, axis=0)
            place = np.empty(len(h), dtype=np.int32)
            place[order] = np.cumsum(new, dtype=np.int32) - 1
            p += weights.take(place, axis=0)
            held.append((order, first, used, weights))
        np.minimum(p, 60, out=p)
        np.exp(p, out=p)
        p *= (-1 / (p @ self.ones))[:, None]
        p.ravel()[np.arange(len(p)) * WIDE + self.child[at]] += 1
        for order, first, used, weights in held:
            summed = np.add.reduceat(p.take(order, axis=0), first, axis=0)
            square = self.square[used] + np.einsum("ij,ij->i", summed, summed)
            self.square[used] = square
            summed *= (STEP / np.sqrt(square))[:, None]
            weights += summed
            self.weights[used] = weights

    def log_likelihood(self, ids: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each token's probability; that of a word that isn't known lacks its count."""
        own, at, rows = self._way(ids, features)
        s = self.bias.take(self.node[at], axis=0)
        for h in rows:
            s += self.weights.take(h, axis=0)
        np.minimum(s, 60, out=s)
        chosen = s.ravel()[np.arange(len(s)) * WIDE + self.child[at]].astype(np.float64)
        np.exp(s, out=s)
        return np.bincount(own, weights=chosen - np.log(s @ self.ones), minlength=len(ids)) - self.shared[ids]

    def batches(self, texts: list[np.ndarray]):
        """(ids, features) of the texts in batches. A batch begins with the whole history of its first token."""
        size = np.array([len(t) for t in texts])
        ids = np.concatenate(texts)
        first = np.repeat(np.cumsum(size) - size, size)
        features = history(ids, first, self.end)
        for k in range(0, len(ids), BATCH):
            yield ids[k : k + BATCH], [f[k : k + BATCH] for f in features]

    def score(self, texts: list[np.ndarray]):
        """Tokens, known words, base score and the model's of each text (as ids); both scores lack the counts of words that aren't known."""
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        log, ids = np.concatenate([self.log_likelihood(*b) for b in self.batches(texts)]), np.concatenate(texts)
        sums = [np.bincount(owner, weights=w, minlength=len(texts)) for w in (self.seen[ids] - self.least, log)]
        return np.bincount(owner, minlength=len(texts)), np.bincount(owner[ids < KNOWN], minlength=len(texts)), sums[0] / LN10, sums[1] / LN10


def _groups(column: pa.Array, most: int = BATCH):
    """Lists of texts (ids) with about ``most`` tokens; a longer text comes by itself."""
    held, size = [], 0
    for t in column:
        ids = np.frombuffer(t.as_buffer(), "<u2")
        if held and size + len(ids) > most:
            yield held
            held, size = [], 0
        held.append(ids)
        size += len(ids)
    if held:
        yield held


def counted(training: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in ``training`` (text), ends included."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        from collections import Counter

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words(t.as_py()))
            seen[END] += b.num_rows
            if len(seen) > 400_000:
                yield one_batch(out, word=list(seen), n=list(seen.values()))
                seen = Counter()
        if seen:
            yield one_batch(out, word=list(seen), n=list(seen.values()))

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """At most KNOWN words and a few sums come to the driver, however large the corpus."""
    two = F.conv(F.hex(F.substring("word", -2, 2)), 16, 10).cast("int")  # the last byte and, above it, the one before, if any
    key = (two.bitwiseAND(255) * 40503 + F.shiftright(two, 8) * 9973) % KEYS
    tails = np.zeros((2, KEYS), dtype=np.int64)
    for r in counts.groupBy(key.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tails[:, r.k] += r.n, r.v
    # Whole steps of the count while they fit, then whole shares of the step that is cut, then words of one share: no task sends more than its part of them.
    step, share = F.floor(F.log2("n") * 64).cast("int"), F.pmod(F.xxhash64("word"), F.lit(SHARES)).cast("int")
    order = lambda rows: sorted(((bytes(r.word), r.n) for r in rows.collect()), key=lambda x: (-x[1], x[0]))
    least, held, cut = 0, 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if held + r["count"] > KNOWN:
            least, cut = r.step + 1, counts.where(step == r.step)
            break
        held += r["count"]
    ranked = order(counts.where(step >= least))
    if cut is not None and held < KNOWN:
        end = 0
        for r in sorted(cut.groupBy(share.alias("share")).count().collect()):
            end = r.share
            if held + r["count"] > KNOWN:
                break
            held += r["count"]
        ranked += order(cut.where(share < end)) + order(cut.where(share == end))[: KNOWN - held]
        ranked.sort(key=lambda x: (-x[1], x[0]))
    return Vocabulary(ranked, int(tails[0].sum()), int(tails[1].sum()), tails)


def encoded(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """The texts (doc_id, held_out, text) as ids: row, doc_id, held_out, ids, and far, the words that aren't known.

    Rows without an id column are a task's counts of contexts before outputs, over
    its training texts: piece, and counts in ``ids``.
    """
    sent = texts.sparkSession.sparkContext.broadcast(v)
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("piece", pa.int32()), ("ids", pa.binary()), ("far", pa.list_(pa.binary()))])

    def run(batches):
        v, row = sent.value, task_partition() << 40
        counts = np.zeros(NONE * CONTEXTS, dtype=np.uint32)
        end = v.id.get(END, -1)
        for b in batches:
            if not b.num_rows:
                continue
            names, held = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < b.num_rows:
                lists, size, start = [], 0, at
                while at < b.num_rows and size < 16 * BATCH:
                    lists.append(tokens_of(b.column(2)[at].as_py()))
                    size += len(lists[-1])
                    at += 1
                flat = list(chain.from_iterable(lists))
                ids = v.ids(flat)
                ends = np.cumsum([len(x) for x in lists])
                firsts = np.r_[0, ends[:-1]]
                learnt = np.repeat(~np.array(held[start:at]), np.diff(np.r_[0, ends]))
                context = last_context(ids, np.repeat(firsts, ends - firsts), end)
                good = learnt & (context < NONE)
                np.add.at(counts, ids[good].astype(np.int64) * CONTEXTS + context[good], np.uint32(1))
                far = np.flatnonzero(ids >= KNOWN)
                cut = np.searchsorted(far, np.r_[0, ends]).tolist()
                strange = [flat[k] for k in far.tolist()]
                yield one_batch(
                    out, row=np.arange(row, row + len(lists)), doc_id=names[start:at], held_out=held[start:at], piece=[None] * len(lists),
                    ids=[ids[x:y].astype("<u2").tobytes() for x, y in zip(firsts, ends)], far=[strange[x:y] for x, y in zip(cut, cut[1:])],
                )
                row += len(lists)
        pieces = counts.reshape(-1, PIECE * CONTEXTS)
        for k in np.flatnonzero(pieces.any(axis=1)):
            yield one_batch(out, row=[None], doc_id=[None], held_out=[None], piece=[int(k)], ids=[pieces[k].astype("<u4").tobytes()], far=[None])

    return texts.select("doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, piece int, ids binary, far array<binary>")


def contexts(coded: DataFrame) -> np.ndarray:
    """Sums of all tasks' counts: outputs x CONTEXTS, whatever the number of texts."""
    out = pa.schema([("piece", pa.int32()), ("ids", pa.binary())])

    def add(batches):
        total: dict = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, "<u4").astype(np.float32)
        for k, x in total.items():
            yield one_batch(out, piece=[k], ids=[x.astype("<f4").tobytes()])

    counts = np.zeros((NONE // PIECE, PIECE * CONTEXTS), dtype=np.float32)
    for r in coded.where("piece is not null").select("piece", "ids").repartition("piece").mapInArrow(add, "piece int, ids binary").toLocalIterator():
        counts[r.piece] = np.frombuffer(bytes(r.ids), "<f4")
    return counts.reshape(NONE, CONTEXTS)


def trained(coded: DataFrame, model: Model, tokens: int, learners: int | None = None, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` of distributed updates, each over its share of the training texts of encoded(), all of them once."""
    spark = coded.sparkSession
    learners = learners or max(1, round(tokens / rounds / LEARN))
    out = pa.schema([("piece", pa.int32()), ("change", pa.binary()), ("square", pa.binary())])
    ddl = "piece int, change binary, square binary"

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            import copy

            own = copy.copy(sent.value)
            before = own.square
            own.weights, own.square, seen = own.weights.copy(), own.square.copy(), False
            for b in batches:
                for texts in _groups(b.column(0)):
                    for batch in own.batches(texts):
                        own.learn(*batch)
                    seen = True
            if seen:
                change = (own.weights - sent.value.weights).reshape(-1, PIECE * WIDE)
                square = (own.square - before).reshape(-1, PIECE)
                for j in np.flatnonzero(square.any(axis=1)):
                    yield one_batch(out, piece=[int(j)], change=[np.clip(change[j], -6e4, 6e4).astype("<f2").tobytes()], square=[square[j].astype("<f4").tobytes()])

        def merge(batches):
            total: dict = {}
            for b in batches:
                for j, change, square in zip(*(b.column(c).to_pylist() for c in range(3))):
                    s = np.frombuffer(square, "<f4").astype(np.float64)
                    moved, n, n2 = total.setdefault(j, [0.0, 0.0, 0.0])
                    total[j] = [moved + np.frombuffer(change, "<f2").reshape(-1, WIDE) * s[:, None], n + s, n2 + s * s]
            for j, (moved, n, n2) in total.items():
                each = n2 / np.maximum(n, 1e-12)  # squared gradient of a learner, and of how many learners
                many = np.maximum(n * n / np.maximum(n2, 1e-12), 1)
                more = 1 + (np.sqrt(many) - 1) * PLENTY / (PLENTY + each)
                yield one_batch(out, piece=[j], change=[(moved / np.maximum(n, 1e-12)[:, None] * more[:, None]).astype("<f4").tobytes()], square=[(each * more**2).astype("<f4").tobytes()])

        mine = coded.where("piece is null and not held_out").where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("ids")
        weights, square = model.weights.copy().reshape(-1, PIECE * WIDE), model.square.copy().reshape(-1, PIECE)
        for r in mine.coalesce(learners).mapInArrow(run, ddl).repartition("piece").mapInArrow(merge, ddl).toLocalIterator():
            weights[r.piece] += np.frombuffer(bytes(r.change), "<f4")
            square[r.piece] += np.frombuffer(bytes(r.square), "<f4")
        model.weights, model.square = weights.reshape(ROWS, WIDE), square.reshape(ROWS)
        sent.unpersist()
    return model


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Null texts count as empty and have the end as their one token. A null id is in
    the fold of the empty text. If no text is to be learnt from, no word is known,
    and both scores are of one unknown word of N = V = 0. Repeated rows are all
    learnt from and scored. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    held = F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), bytes_of().alias("text"))
    counts = written(counted(texts.where("not held_out")), "words")
    v = vocabulary(counts)
    coded = written(encoded(texts, v), "encoded")
    model = trained(coded, Model(v, contexts(coded)), v.tokens)
    model.square = None
    sent = spark.sparkContext.broadcast(model)
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            at = 0
            for texts in _groups(b.column(3)):
                n = len(texts)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, n) for k in range(3)), *(pa.array(x) for x in sent.value.score(texts))], schema=out)
                at += n

    rows = coded.where("piece is null")
    done = rows.select("row", "doc_id", "held_out", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    far = rows.select("row", F.explode("far").alias("word")).join(counts.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("found"))
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return done.join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
