"""Operator 9, mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of all sizes; it is filled with whole repetitions
of the source and a rest. The rest is fitted by counting documents by exact
length: an equal share of every length first, then longest lengths first, then a
bounded-knapsack dynamic programme (binary splitting over a bit set) over what is
left, which is less than a bounded number of words. Where a source's documents,
each once, give no exact sum, each may be taken as often as is allowed. The fit
works on counts by length alone. Which documents of a length are taken is decided by
a seeded hash of the row: the plan holds, for each length, the hash up to which rows
are taken once more, found by counting buckets of the hash and then the one bucket
that is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import one_batch, removed, sorted_groups, table, task_partition, tune, written

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 9
#: Bits of the seeded hash, and of its beginnings by which documents of one length are counted rather than sorted.
DRAW_BITS, BUCKET_BITS = 62, (7, 14)
#: Words that the dynamic programme fills at most.
DP_WORDS = 1 << 17
#: Rows of a table of lengths that is sent to every task at most; shares of the rows of a length beyond that.
SENT, SALTS = 1 << 16, 32


def targets(sizes: dict, weights: tuple = WEIGHTS, most: float = MOST) -> dict:
    """Target of each source, given its size: by weight, in order of code points with null last; none above ``most`` times its size, the excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * share > most * sizes[s]]
        if not full:
            out |= {s: weight[s] * share for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take, none above its count, for a sum of at most ``budget`` and as near as can be found.

    Exact (the nearest sum there is from below) where at most DP_WORDS words are
    left after the greedy part, which gives back what the programme needs to move.
    """
    counts = {size: n for size, n in counts.items() if size > 0 and n > 0}
    total = sum(s * n for s, n in counts.items())
    if budget >= total:
        return dict(counts)
    take = {s: n * budget // total for s, n in counts.items()}
    left = budget - sum(s * n for s, n in take.items())
    for s in sorted(counts, reverse=True):
        more = min(counts[s] - take[s], max(0, left - DP_WORDS // 2) // s)
        take[s] += more
        left -= more * s
    share = max(0, DP_WORDS - left) // len(counts)
    for s in sorted(counts):  # give back a share of each, all of it where the budget is small, so that there is room for an exact sum
        back = min(take[s], max(2, share // s), max(0, DP_WORDS - left) // s)
        take[s] -= back
        left += back * s
    reach, steps = 1, []
    by = np.full(left + 1, -1, dtype=np.int32)  # the step that first reached each sum
    mask = (1 << (left + 1)) - 1
    for s in sorted(counts, reverse=True):
        room, part = min(counts[s] - take[s], left // s), 1
        while room > 0:
            k = min(part, room)
            new = (reach << (s * k)) & mask & ~reach
            if new:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little"))
                by[at] = len(steps)
                steps.append((s, k))
                reach |= new
            room -= k
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at:  # what was left before a step was reached by earlier ones
        s, k = steps[by[at]]
        take[s] += k
        at -= s * k
    return take


def taken(counts: dict[int, int], size: int, target: float, most: int) -> list[tuple[int, int]]:
    """For each length of a source: how often all its documents are taken, and how many of them once more."""
    whole = min(most, int(target // size)) if size else 0
    rest = 0 if whole == most else max(0, round(target) - whole * size)
    words_of = lambda taken: sum(s * k for s, k in taken.items())
    # Every document the same number of times and a part of them once more; where that isn't exact, as often as is allowed.
    more = fit(counts, rest)
    best = {s: whole * n + more.get(s, 0) for s, n in counts.items()}
    for least in (whole, 0):
        if size and words_of(best) < round(target):
            more = fit({s: n * (most - least) for s, n in counts.items()}, round(target) - least * size)
            best = max(best, {s: least * n + more.get(s, 0) for s, n in counts.items()}, key=words_of)
    return [divmod(best[s], n) for s, n in counts.items()]


def sized(docs: DataFrame, size: str, draw: str, seed: int) -> DataFrame:
    """The rows with two more columns: words of the text, 0 for null, and a seeded hash of the row's id, source and text."""
    seeded = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source").cast("string"), F.col("text")), F.lit(1 << DRAW_BITS))
    return docs.withColumn(draw, seeded).withColumn(size, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def goals(rows: DataFrame, weights: tuple, most: float) -> DataFrame:
    """(source, source_size, target) of ``rows`` (source, size): what targets() gives, without a list of all sources in one place.

    Sources are numbered in sorted parts; then the share of a unit of weight rises
    round by round, each time by what the sources that are full leave over.
    """
    out = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])

    def number(batches):
        part, place = task_partition(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(b.num_rows, part)), pa.array(np.arange(place, place + b.num_rows))], schema=out)
            place += b.num_rows

    order = F.col("source").asc_nulls_last()
    sums = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    placed = written(sums.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(number, "source string, source_size long, part long, place long"), "sources")
    before, total = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # a number for each part
        before += [F.lit(part), F.lit(total)]
        total += n
    rank = F.col("place") + (F.create_map(*before)[F.col("part")] if before else F.lit(0))
    weighed = placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    limit = F.col("source_size") * most / F.col("weight")
    share = 0.0
    while True:
        free = limit >= share
        full, weight, whole = weighed.agg(F.sum(F.when(~free, F.col("source_size") * most)), F.sum(F.when(free, F.col("weight"))), F.sum("source_size")).first()
        new = (float(whole or 0) - float(full or 0)) / weight if weight else share
        if not weight or new <= share:
            break
        share = new
    return weighed.select("source", "source_size", F.when(limit < share, F.col("source_size") * float(most)).otherwise(F.col("weight") * share).cast("double").alias("target"))


def same(a: DataFrame, b: DataFrame):
    return a.source.eqNullSafe(b.source) & (a["size"] == b["size"])


def with_lengths(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``rows`` (source, size, draw, ...) joined with a table of lengths (source, size, ...). The latter is sent to all tasks if it is small; else it is repeated for each of SALTS shares of the rows, so that a length that many rows have goes to many tasks."""
    extra = [c for c in lengths.columns if c not in ("source", "size")]
    if lengths.count() <= SENT:
        lengths = F.broadcast(lengths)
        return rows.join(lengths, same(rows, lengths)).select(*(rows[c] for c in rows.columns), *extra)
    salted = rows.withColumn("__mix_salt", F.pmod(F.col("draw"), F.lit(SALTS)).cast("int"))
    many = lengths.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, same(salted, many) & (salted["__mix_salt"] == many["__mix_salt"])).select(*(salted[c] for c in rows.columns), *extra)


def plan(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size, source_size, target, whole, edge, of_edge, at_edge) of each length in ``rows`` (source, size, draw).

    Each row of the length is taken ``whole`` times, and once more if its draw is
    below ``edge``; of the ``at_edge`` rows that have this draw, ``of_edge`` once more.
    """

    out = pa.schema([("source", pa.string()), *((c, pa.float64() if c == "target" else pa.int64()) for c in ("size", "source_size", "target", "whole", "more"))])

    def choose(batches):
        for group in sorted_groups(batches, 1):
            names, sizes, totals, aims, many = (group.column(c).to_pylist() for c in ("source", "size", "source_size", "target", "n"))
            k = 0
            while k < len(names):
                end = k + 1
                while end < len(names) and names[end] == names[k]:
                    end += 1
                whole, more = zip(*taken(dict(zip(sizes[k:end], many[k:end])), totals[k], aims[k], most))
                yield one_batch(out, source=names[k:end], size=sizes[k:end], source_size=totals[k:end], target=aims[k:end], whole=whole, more=more)
                k = end

    aims = goals(rows, weights, most)
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    both = lengths.join(aims, lengths.source.eqNullSafe(aims.source)).drop(aims.source).repartition("source").sortWithinPartitions("source", "size")
    fitted = written(both.mapInArrow(choose, "source string, size long, source_size long, target double, whole long, more long"), "mix")
    # Of the lengths that are cut: by ever longer beginnings of the draw, the one in which the count is reached; then the draw.
    held, steps = written(fitted.where("more > 0").select("source", "size", "more", F.lit(0).cast("long").alias("begins")), "cut"), (*BUCKET_BITS, DRAW_BITS)
    done = [fitted, held]
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for was, now in zip((0, *steps), steps):
        near = with_lengths(rows.select("source", "size", "draw"), held).where(F.shiftright("draw", DRAW_BITS - was) == F.col("begins"))
        near = near.groupBy("source", "size", "more", F.shiftright("draw", DRAW_BITS - now).alias("next")).agg(F.count("*").alias("n"))
        near = near.withColumn("before", ahead).where("before < more and before + n >= more").select("source", "size", (F.col("more") - F.col("before")).alias("more"), F.col("next").alias("begins"), "n")
        held = written(near, "cut")
        done.append(held)
    edges = held.select("source", "size", F.col("begins").alias("edge"), F.col("more").alias("of_edge"), F.col("n").alias("at_edge"))
    whole = written(fitted.join(edges, same(fitted, edges), "left").select(fitted.source, fitted["size"], "source_size", "target", "whole", "edge", "of_edge", "at_edge"), "plan")
    removed(*done)
    return whole


def dealt(rows: DataFrame, lengths: DataFrame, copies: str) -> DataFrame:
    """``rows`` (source, size, draw, ...) with source_size, target and how often each is taken, by plan().

    Where a draw is shared by several rows and only some of them are taken once
    more, equal rows are counted before any of them moves, and different ones go in
    the order of all their columns.
    """
    found = with_lengths(rows, lengths)
    at = F.col("draw") == F.col("edge")
    some = at & (F.col("of_edge") < F.col("at_edge"))
    once = F.when(F.col("draw") < F.col("edge"), 1).when(at, 1).otherwise(0)
    keep = [*rows.columns, "source_size", "target"]
    out = found.where(~F.coalesce(some, F.lit(False))).select(*keep, (F.col("whole") + F.coalesce(once, F.lit(0))).alias(copies))
    if not lengths.where("of_edge < at_edge").limit(1).count():
        return out
    every = [*keep, "whole", "of_edge"]
    tied = found.where(some).groupBy(*every).agg(F.count("*").alias("__mix_n"))
    ahead = F.coalesce(F.sum("__mix_n").over(Window.partitionBy("source", "size").orderBy(*rows.columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = tied.withColumn("__mix_before", ahead).withColumn("__mix_at", F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int"))))
    return out.unionAll(tied.select(*keep, (F.col("whole") + (F.col("__mix_before") + F.col("__mix_at") <= F.col("of_edge")).cast("long")).alias(copies)))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often the mix takes each row of ``docs`` (doc_id, source, text).

    Nulls, repeated rows, empty texts and empty tables as in mix().
    """
    tune(docs.sparkSession)
    rows = sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), "size", "draw", seed)
    rows = written(rows.select("doc_id", "source", "size", "draw"), "sizes")
    return dealt(rows, plan(rows, weights, most), "copies").drop("draw")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, source, text).

    Null texts have size 0; they and empty texts count in nothing. A null source is
    a source of its own, last in order. Rows that repeat an id are rows of their
    own. Other columns are ignored. No rows give no rows.
    """
    return copies(docs, weights, most, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, ...), with all their columns, each as often as the mix takes it.

    A row's size and draw are made anew from its own columns and looked up in the
    plan of lengths, so texts don't move and an id in several sources, or a null
    one, is no special case. Nulls, repeated rows, empty texts and empty tables as
    in mix(); a row that the mix doesn't take is left out. ``docs`` has to give the
    same rows each time it is read.
    """
    tune(docs.sparkSession)
    rows = sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), "size", "draw", seed)
    rows = written(rows.select("source", "size", "draw"), "sizes")
    lengths = plan(rows, weights, most)
    removed(rows)
    # The columns of docs travel as one, under a name that nothing else has.
    whole = sized(docs.select(F.struct(*docs.columns).alias("__mix_row"), "doc_id", F.col("source").cast("string").alias("source"), "text"), "size", "draw", seed)
    taken = dealt(whole.select("__mix_row", "source", "size", "draw"), lengths, "copies")
    repeated = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))))  # no copy, no row
    return taken.select("__mix_row", repeated.alias("__mix_at")).select("__mix_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
