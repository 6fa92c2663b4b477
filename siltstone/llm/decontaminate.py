"""Operator 7, benchmark decontamination by a BM25 index of test items with block-max WAND.

Test items are the indexed documents, training passages the queries. Impacts are
BM25 weights divided by the item's own total, so that one threshold serves all
items: an item is retrieved if a passage holds at least ``THETA`` of its BM25
mass. Passages are windows of twice the longest item, half overlapping, so every
item that stands in a text lies wholly in one of its passages.

Whole texts are filtered first by vector operations of bounded size: the block-max
bound of each (passage, block of items), where terms that most items share count
at their largest sum in the block. What passes goes through WAND with block-max
skipping. Retrieved items are verified on the whole text by the coverage of their
words with shared five-word shingles, apart for question and answer.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, table, tune

K1, B, THETA, SHINGLE, SIMILAR = 1.2, 0.75, 0.6, 5, 0.8
#: Least coverage of the question and of the answer alone; both together need SIMILAR.
QUESTION, ANSWER = 0.7, 0.5
#: Items of a block; share of the items above which a term counts as common.
BLOCK, COMMON = 4, 0.03
#: Bytes of test items that are indexed and broadcast at once. More items are taken in turn, in so many passes.
INDEX_BYTES = 32 << 20
#: Pairs of a term in a text and a block that are summed at once.
PAIRS = 1 << 19
EDGE = b".,;:!?\"'()[]{}<>*&%$#|-_"


def terms(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation at their ends. Letters beyond A-Z are lower-cased too, as whole texts in capitals hold items as well."""
    text = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return [w.strip(EDGE) for w in text.split()]


def answer_start(text: bytes) -> int:
    """Number of words before the answer: the last sentence or line, a quarter of the words at least."""
    n = len(text.split())
    cut = [m.end() for m in re.finditer(rb"[.!?]\s+|\n\s*", text.rstrip())]
    last = len(text[: cut[-1]].split()) if cut else n
    return max(0, min(last, n - -(-n // 4)))


def _shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each n ids in a row, equal for equal ids."""
    out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = (out ^ (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Index:
    names: list
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]  # term ids of each item
    answer: list[int]
    postings: list[tuple[np.ndarray, np.ndarray]]  # of each term: items, impacts
    tops: np.ndarray
    block_tops: list[dict[int, float]]
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]  # block bounds of uncommon terms: starts by term, blocks, bounds
    common_sum: np.ndarray
    half: int
    shingles: list[np.ndarray] = field(default_factory=list)


@dataclass
class Statistics:
    """What is counted over all items, whatever part of them an index holds."""

    items: int
    words: int
    longest: int
    frequency: dict[bytes, int]  # items that hold each term


def count(texts: list[bytes]) -> Statistics:
    lists = [terms(t) for t in texts if t and t.split()]
    return Statistics(len(lists), sum(map(len, lists)), max(map(len, lists), default=1), Counter(w for ws in lists for w in set(ws)))


def build(items: list[tuple[object, bytes]], of_all: Statistics | None = None) -> Index:
    """An index of ``items``, weighed by the statistics of all items."""
    all_ = of_all or count([t for _, t in items])
    items = [(i, t) for i, t in items if t and t.split()]
    texts = [terms(t) for _, t in items]
    vocabulary: dict[bytes, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int64) for ws in texts]
    n, v = len(items), len(vocabulary)
    mean = all_.words / max(1, all_.items)
    df = np.array([all_.frequency[w] for w in vocabulary], dtype=float)
    idf = np.log1p((all_.items - df + 0.5) / (df + 0.5))
    common = df > max(1, COMMON * all_.items)
    lists: list[list[tuple[int, float]]] = [[] for _ in range(v)]
    blocks = -(-n // BLOCK)
    common_sum = np.zeros(blocks)
    for i, w in enumerate(words):
        u, tf = np.unique(w, return_counts=True)
        weight = idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        weight /= weight.sum()
        for t, x in zip(u, weight):
            lists[t].append((i, float(x)))
        common_sum[i // BLOCK] = max(common_sum[i // BLOCK], weight[common[u]].sum())
    block_tops = []
    for found in lists:
        top: dict[int, float] = {}
        for i, x in found:
            top[i // BLOCK] = max(top.get(i // BLOCK, 0.0), x)
        block_tops.append(top)
    rare = [[] if common[t] else sorted(block_tops[t].items()) for t in range(v)]
    starts = np.cumsum([0, *map(len, rare)])
    return Index(
        [i for i, _ in items], vocabulary, words, [answer_start(t) for _, t in items],
        [(np.array([i for i, _ in f], dtype=np.int64), np.array([x for _, x in f])) for f in lists],
        np.array([max((x for _, x in f), default=0.0) for f in lists]), block_tops,
        (starts, np.array([b for r in rare for b, _ in r], dtype=np.int64), np.array([x for r in rare for _, x in r])),
        common_sum, all_.longest, [_shingles(w, min(SHINGLE, len(w))) for w in words],
    )


def retrieve(index: Index, query: np.ndarray, theta: float = THETA) -> list[tuple[int, float]]:
    """All (item, score) of at least ``theta`` for a query's distinct terms, by WAND with block-max skipping."""
    lists = [[0, t, *index.postings[t]] for t in query]  # cursor, term, items, impacts
    out, end = [], len(index.names)
    slack = 1e-9
    while True:
        lists = [x for x in lists if x[0] < len(x[2])]
        lists.sort(key=lambda x: x[2][x[0]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += index.tops[x[1]]
            if bound >= theta - slack:
                pivot = k
                break
        if pivot < 0:
            return out
        item = int(lists[pivot][2][lists[pivot][0]])
        while pivot + 1 < len(lists) and lists[pivot + 1][2][lists[pivot + 1][0]] == item:
            pivot += 1
        block = item // BLOCK
        if sum(index.block_tops[x[1]].get(block, 0.0) for x in lists[: pivot + 1]) < theta - slack:
            # No item of the block can do with these lists: go on behind it, or where the next list begins.
            ahead = int(lists[pivot + 1][2][lists[pivot + 1][0]]) if pivot + 1 < len(lists) else end
            goal = max(item + 1, min((block + 1) * BLOCK, ahead))
        elif lists[0][2][lists[0][0]] == item:
            score = sum(x[3][x[0]] for x in lists[: pivot + 1])
            if score >= theta - slack:
                out.append((item, float(score)))
            goal = item + 1
        else:
            goal = item
        for x in lists[: pivot + 1]:
            if x[2][x[0]] < goal:
                x[0] += int(np.searchsorted(x[2][x[0] :], goal))


def overlaps(index: Index, item: int, ids: np.ndarray) -> tuple[float, float, float]:
    """Share of the item's words, of its question's and of its answer's, that shared shingles cover."""
    n = min(SHINGLE, len(index.words[item]))
    there = np.isin(index.shingles[item], _shingles(ids, n))
    covered = np.zeros(len(index.words[item]), dtype=bool)
    for k in range(n):
        covered[k : k + len(there)] |= there
    a = index.answer[item]
    mean = lambda x: float(x.mean()) if len(x) else 1.0
    return mean(covered), mean(covered[:a]), mean(covered[a:])


def _passes(index: Index, query: np.ndarray, theta: float) -> bool:
    """Whether the block-max bound of distinct terms reaches the threshold in some block."""
    starts, blocks, bounds = index.rare
    size = starts[query + 1] - starts[query]
    take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[query], size)
    sums = np.bincount(blocks[take], weights=bounds[take], minlength=len(index.common_sum))
    return bool((sums + index.common_sum >= theta - 1e-9).any())


def _passing(index: Index, ids: np.ndarray, theta: float) -> np.ndarray:
    """The passages of a text in some block of which the block-max bound reaches the threshold. A bounded number of (term, block) pairs is looked at at once, however long the text is."""
    starts, blocks, bounds = index.rare
    halves, wide = (len(ids) - 1) // index.half + 1, len(index.common_sum)
    if (index.common_sum >= theta - 1e-9).any():
        return np.arange(halves)  # common terms alone might do
    at = np.flatnonzero(ids >= 0)
    size = starts[ids[at] + 1] - starts[ids[at]]
    pairs = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(at, np.arange(halves + 1) * index.half)]  # before each half
    out, low = [], 0
    while low < halves:
        high = max(low + 2, int(np.searchsorted(pairs, pairs[low] + PAIRS, "right")) - 1)
        own = at[np.searchsorted(at, low * index.half) : np.searchsorted(at, high * index.half)]
        n = starts[ids[own] + 1] - starts[ids[own]]
        take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[ids[own]], n)
        place = np.repeat(own // index.half - low, n)
        # A passage is a half and the next one, so a pair counts in its own half's passage and in the one before.
        keys = np.concatenate([place, place - 1]) * wide + np.tile(blocks[take], 2)
        weight = np.tile(bounds[take], 2)
        last = high - low - (high < halves)  # the last half of a part is the first of the next
        if last * wide <= 1 << 14:
            inside = (keys >= 0) & (keys < last * wide)
            sums = np.bincount(keys[inside], weights=weight[inside], minlength=last * wide).reshape(last, wide)
            good = np.flatnonzero((sums + index.common_sum >= theta - 1e-9).any(axis=1))
        else:
            inside = (keys >= 0) & (keys < last * wide)
            used, which = np.unique(keys[inside], return_inverse=True)
            enough = np.bincount(which, weights=weight[inside], minlength=len(used)) + index.common_sum[used % wide] >= theta - 1e-9
            good = np.unique(used[enough] // wide)
        out.append(low + good)
        low = high - 1 if high < halves else halves
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def search(index: Index, text: bytes, theta: float = THETA, memo: dict | None = None) -> list[tuple[int, float, float, float, float]]:
    """(item, score, overlap, question's, answer's) of the items that a text holds."""
    if not index.names:
        return []
    get = index.vocabulary.get
    ids = np.array([get(w, -1) for w in terms(text)], dtype=np.int64)
    if not (ids >= 0).any():
        return []
    passing = _passing(index, ids, theta)
    found: dict[int, float] = {}
    for w in passing:
        passage = ids[w * index.half : (w + 2) * index.half]
        query = np.unique(passage[passage >= 0])
        key = query.tobytes()
        got = memo.get(key) if memo is not None else None
        if got is None:
            got = retrieve(index, query, theta) if _passes(index, query, theta) else []
            if memo is not None:
                if len(memo) > 20_000:
                    memo.clear()
                memo[key] = got
        for item, score in got:
            found[item] = max(score, found.get(item, 0.0))
    out = []
    for item, score in sorted(found.items()):
        both, question, answer = overlaps(index, item, ids)
        if both >= SIMILAR and question >= QUESTION and answer >= ANSWER:
            out.append((item, score, both, question, answer))
    return out


def _terms(items: DataFrame) -> DataFrame:
    """(terms, words): the distinct terms of each item (text) that has words, and how many words it has."""
    out = pa.schema([("terms", pa.list_(pa.binary())), ("words", pa.int64())])

    def run(batches):
        for b in batches:
            lists = [terms(t.as_py()) for t in b.column(0) if t.as_py().split()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(x)) for x in lists], pa.list_(pa.binary())), pa.array(list(map(len, lists)), pa.int64())], schema=out)

    return items.select("text").mapInArrow(run, "terms array<binary>, words long")


def leaks(docs: DataFrame, benchmark: DataFrame, theta: float = THETA) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap of every test item (``benchmark``: item_id, text) that a text of ``docs`` (doc_id, text) holds.

    Null and empty texts, of either table, hold nothing. Rows that repeat an id,
    and items that repeat a text, are all matched. Other columns are ignored.
    No documents or no items give no rows. More items than fit an index are taken in
    several passes over the documents, weighed by the statistics of all items.
    """
    spark = docs.sparkSession
    tune(spark)
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "overlap", "question_overlap", "answer_overlap"))])
    ddl = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), bytes_of().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // INDEX_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("text"))
    counted = _terms(items)
    n, words, longest = counted.agg(F.count("*"), F.sum("words"), F.max("words")).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    parts = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        held = frequency if passes == 1 else frequency.join(_terms(part).select(F.explode("terms").alias("term")).distinct(), "term", "left_semi")
        of_all = Statistics(n, words or 0, longest or 1, {bytes(r.term): r.n for r in held.collect()})
        own = sorted(((r.item_id, bytes(r.text)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        sent = spark.sparkContext.broadcast(build(own, of_all))

        def run(batches, sent=sent):
            index, memo = sent.value, {}
            for b in batches:
                got = [(d, index.names[i], *rest) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for i, *rest in search(index, t.as_py(), theta, memo)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got) if got else [[]] * len(out), out)], schema=out)

        parts.append(rows.mapInArrow(run, ddl))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns.

    All rows of an id go if one of them leaks; rows with a null id are judged by their
    own text. Null and empty texts stay. No items, or no documents, change nothing.
    """
    from .common import written

    named = docs.where("doc_id is not null")
    bad = written(leaks(named, benchmark).select("doc_id").distinct(), "leaks")
    kept = named.join(bad, "doc_id", "left_anti")
    nameless = docs.where("doc_id is null")
    if not nameless.limit(1).count():
        return kept
    nameless = nameless.withColumn("doc_id", F.xxhash64("text"))
    bad = written(leaks(nameless, benchmark).select("doc_id").distinct(), "leaks")
    return kept.unionByName(nameless.join(bad, "doc_id", "left_anti").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
