"""Near-duplicates by SimHash fingerprints of word shingles, verified by Jaccard similarity; links that the fingerprints don't show are found by shared shingles.

SimHash comes first: a set's fingerprint has the bits of most of its shingles,
and the generalised pigeonhole search of operator 6 gives fingerprints at most
``TAU`` bits apart. Each is compared, on whole sets, with the smallest and the
nearest that it is linked with, and with the first set of an equal fingerprint.

Sets of similarity 4/5 may differ in more bits, and fingerprints meet that belong
to others. So what isn't in one component by then is looked for by shingles.
Two sets of similarity 4/5 at least share a shingle among the first
``n - ceil(4n/5) + 1`` of each, whatever the order of all shingles, so an
equi-join of these beginnings misses no pair. The order puts rare shingles first,
by counts in a hashed table of fixed size.

Equal sets are one node before any pair is looked at. The members of a shared
shingle are first compared with the one that has the fewest rarer shingles, the
middle of a group of near copies if there is one; what that links is one component,
and only pairs across components are looked at afterwards, so that a large group
of near copies doesn't give all its pairs. Every pair is verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bytes_of, joined_by, one_batch, removed, tune, words, written
from .components import components

SHINGLE, SEED = 5, 42
#: Bits in which linked fingerprints differ at most; cost of a shuffled key, in compared fingerprints.
TAU, KEY_COST = 8, 1000.0
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Bytes of an Arrow batch, and rows that are read from Parquet together: sets are several times as long as their rows.
BATCH_BYTES, READ_ROWS = 2 << 20, 256
#: Counters of the hashed table; how many travel together; rows of a shingle that one task pairs with one another; nodes that are sent to every task at most.
COUNTERS, PIECE, BLOCK, SENT = 1 << 20, 1 << 12, 2048, 1 << 20


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's word shingles as sorted hashes; a shorter text is one shingle, one without words has none."""
    w = words(text)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(w[i : i + shingle]), SEED) for i in range(max(1, len(w) - shingle + 1))] if w else [], dtype="<u8"))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets is OVER / UNDER at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (OVER + UNDER) >= OVER * (len(a) + len(b))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text, node, fp, hashes): a hash that stands for the text, one that stands for its set of shingles, the SimHash of the set, and the set."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([simhash.majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(nodes), pa.array(fps), pa.array([s.tobytes() for s in sets], type=pa.binary())], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of().alias("text"), _of_text("text").alias("hash")).mapInArrow(run, "doc_id long, text long, node long, fp long, hashes binary")


def _of_text(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles each counter has: COUNTERS numbers, whatever the number of rows."""
    out = pa.schema([("piece", pa.int32()), ("n", pa.binary())])

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            h = np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(x.as_py(), "<u8") for x in b.column(0))])
            np.add.at(total, (h % np.uint64(COUNTERS)).astype(np.int64), 1)
        for k, piece in enumerate(total.reshape(-1, PIECE)):
            if piece.any():
                yield one_batch(out, piece=[k], n=[piece.astype("<u4").tobytes()])

    def add(batches):
        total: dict = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, "<u4").astype(np.int64)
        for k, n in total.items():
            yield one_batch(out, piece=[k], n=[np.minimum(n, 2**32 - 1).astype("<u4").tobytes()])

    counts = np.zeros((COUNTERS // PIECE, PIECE), dtype=np.uint32)
    for r in sets.select("hashes").mapInArrow(run, "piece int, n binary").repartition("piece").mapInArrow(add, "piece int, n binary").collect():
        counts[r.piece] = np.frombuffer(bytes(r.n), "<u4")
    return counts.ravel()


def beginnings(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, node, n, pos): the rarest shingles of each set, as many as no similar set can do without."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)
    out = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        counts = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys, nodes, sizes, places = [], [], [], []
                for node, x in zip(b.column(0)[at : at + 256].to_pylist(), b.column(1)[at : at + 256].to_pylist()):
                    h = np.frombuffer(x, "<u8")
                    if not len(h):
                        continue
                    first = len(h) - -(-OVER * len(h) // UNDER) + 1
                    order = np.lexsort((h, counts[(h % np.uint64(COUNTERS)).astype(np.int64)]))[:first]
                    keys.append(h[order].view(np.int64))
                    nodes.append(np.full(first, node, dtype=np.int64))
                    sizes.append(np.full(first, len(h), dtype=np.int32))
                    places.append(np.arange(first, dtype=np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, sizes, places)], schema=out)

    return sets.select("node", "hashes").mapInArrow(run, "key long, node long, n int, pos int")


def shared(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (key, node, n, pos) whose key is in another row too. A task holds a batch and a row, however many rows a key has."""
    out = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        last, given = None, False  # the row before the batch, and whether it has been given
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy() for k in range(3)]
            if last is not None:
                now = [np.r_[x, y] for x, y in zip(last, now)]
            key, node, size = now
            same = key[1:] == key[:-1]
            found = np.r_[False, same] | np.r_[same, False]
            first = found.copy()
            if last is not None and given:
                first[0] = False
            if first.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(node[first]), pa.array((size[first] >> 32).astype(np.int32)), pa.array((size[first] & 0xFFFFFFFF).astype(np.int32))], schema=out)
            last, given = [x[-1:] for x in now], bool(found[-1]) or (len(key) == 1 and given)

    packed = rows.select("key", "node", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("size"))
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, n int, pos int")


def _possible(a: str, b: str):
    """Whether sizes and places leave room for the similarity, if the shingle is the first that both have."""
    room = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return room * (OVER + UNDER) >= OVER * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets are similar."""
    met = written(pairs.distinct(), "pairs")
    needed = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    if needed.count() <= SENT:
        needed = F.broadcast(needed)
    some = written(sets.join(needed, "node", "left_semi").select("node", "hashes").dropDuplicates(["node"]), "needed")
    left, right = some.select(F.col("node").alias("a"), F.col("hashes").alias("x")), some.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [alike(np.frombuffer(x[k].as_py(), "<u8"), np.frombuffer(y[k].as_py(), "<u8")) for k in range(batch.num_rows)]
            found = batch.select([0, 1]).filter(pa.array(good, type=pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, schema=edge)

    out = written(met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    removed(met, some)
    return out


def fingerprint_links(sets: DataFrame, tau: int = TAU, block: int = simhash.BLOCK) -> DataFrame:
    """(a, b): links between nodes of similar sets, whose fingerprints differ in at most ``tau`` bits. At most two for each fingerprint, and one for each other node of an equal one."""
    nodes = written(sets.select("node", "fp").distinct(), "nodes")
    fps = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "fps")
    pairs = joined_by(nodes, fps, "fp", "n").where("node <> least").select("node", F.col("least").alias("other"))
    plan = simhash.choose_plan(fps, tau, KEY_COST)
    if plan:
        met = simhash.links(fps, plan, tau, block, forest=False)
        met = met.groupBy("a").agg(F.min("b").alias("low"), F.min(F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))), "b")).alias("near"))
        met = written(met.select("a", F.explode(F.array_distinct(F.array("low", "near.b"))).alias("b")), "met")
        first, second = fps.select(F.col("fp").alias("a"), F.col("least").alias("node")), fps.select(F.col("fp").alias("b"), F.col("least").alias("other"))
        pairs = pairs.union(met.join(first, "a").join(second, "b").select("node", "other"))
    out = verified(pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")), sets)
    removed(nodes, fps, *([met] if plan else []))
    return out


def links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes that leave the same components as all pairs of similar sets: those of the fingerprints, and what is missing by shingles."""
    known = fingerprint_links(sets, block=block)
    held = written(shared(beginnings(sets, shingle_counts(sets))).distinct(), "shared")
    named = _named(held, known)
    lead = named.groupBy("key").agg(F.min(F.struct("pos", "node", "n", "component")).alias("q"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    parted = written(named.join(lead, "key").select("key", F.struct("node", "n", "pos", "component").alias("p"), "q"), "parted")
    star = parted.where((F.col("p.component") != F.col("q.component")) & _possible("p", "q"))
    known = known.union(verified(star.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")), sets))
    named = _named(parted.select("key", "p.node", "p.n", "p.pos"), known)
    several = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows")).where("least <> most")
    blocks = F.ceil(F.col("rows") / block).cast("int")
    dealt = (
        named.join(several.select("key", blocks.alias("blocks")), "key")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "pos", "component")
    )
    dealt = written(dealt, "dealt")
    inside = (F.col("p.own") == F.col("i")) & (F.col("q.own") == F.col("j")) & ((F.col("i") != F.col("j")) | (F.col("p.node") < F.col("q.node")))
    across = dealt.alias("p").join(dealt.alias("q"), ["key", "i", "j"]).where(inside & (F.col("p.component") != F.col("q.component")) & _possible("p", "q"))
    last = verified(across.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")), sets)
    removed(held, parted, dealt)
    return known.union(last)


def _named(held: DataFrame, known: DataFrame) -> DataFrame:
    """``held`` with the component that the ``known`` links give each node, itself if there is none."""
    return held.join(components(known), "node", "left").withColumn("component", F.coalesce("component", "node"))


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, group, component_id) for each row of ``docs``: text is a hash of it, group stands for its component, component_id is the smallest id of that."""
    tune(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    sets = written(shingle_sets(docs), "sets")
    distinct = written(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(sets, block))
    ids = written(sets.select("doc_id", "text", "node"), "ids")
    removed(sets)
    linked = distinct.join(found, "node").select("node", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("node", "component", "component_id")
    classes = written(distinct.join(linked, "node", "left").select("node", "n", F.coalesce("component", "node").alias("group"), F.coalesce("component_id", "least").alias("component_id")), "classes")
    return joined_by(ids, classes, "node", "n").select("doc_id", "text", "group", "component_id")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text): component_id is the smallest doc_id reachable by links of similar texts.

    Null texts count as empty; texts without words are alike. Rows with a null id
    are in the component of what they are linked with, null if nothing there has an id.
    Repeated rows are all returned, other columns ignored. No rows give no rows.
    """
    return groups(docs, block).select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component of near_duplicates(), with all its columns: the one with the smallest id, of equal ids the text with the smallest hash.

    Null and empty texts are alike, so one of them stays. Of a component without any
    id one row stays, and rows of one id whose texts aren't alike are documents of
    their own. No rows give no rows.
    """
    found = written(groups(docs), "groups")
    kept = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text")).alias("x")).select("x.doc_id", F.col("x.text").alias("__near_text"))
    rows = docs.withColumn("__near_text", _of_text("text"))
    rows = rows.join(kept.hint("shuffle_hash"), rows.doc_id.eqNullSafe(kept.doc_id) & (rows["__near_text"] == kept["__near_text"]), "left_semi")
    if found.groupBy("doc_id", "text").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "__near_text"])
    return rows.drop("__near_text")
