"""Nearest prototypes of vectors, votes, medoids and means, over tables of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ocr.glyphs import EPSILON, medoids

#: Prototypes that are sent to every task at most; rows of a label among which its medoids are sought.
PROTOTYPES, CHOICE, SEED = 100_000, 512, 7
#: Rows of a shard and queries of a block of an exact search.
SHARD, BLOCK = 1 << 16, 1 << 13


def label_means(vectors: DataFrame) -> DataFrame:
    """(label, vector): the mean vector of each label."""
    rows = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select("label", F.transform("v", lambda s: s["m"]).alias("vector"))


def nearest(vectors: DataFrame, prototypes: DataFrame, k: int) -> DataFrame:
    """vec_id, label, rank, distance: the k nearest of ``prototypes`` (label, vector) to each row of ``vectors`` (vec_id, embedding), ties by label.

    Prototypes are a table of checked size, as they go to every task. Rows without
    a vector have no neighbour.
    """
    held = sorted(prototypes.limit(PROTOTYPES + 1).collect(), key=lambda r: r["label"])
    if len(held) > PROTOTYPES:
        raise ValueError(f"more than {PROTOTYPES} prototypes: thin them out by label_medoids()")
    names = np.array([r["label"] for r in held])
    sent = vectors.sparkSession.sparkContext.broadcast((names, np.array([r["vector"] for r in held], dtype=np.float64)))

    def run(batches):
        names, known = sent.value
        for b in batches:
            b = b[b.v.notna()]
            if not len(b) or not len(names):
                continue
            x = np.stack(b.v.to_numpy()).astype(np.float64)
            for at in range(0, len(x), step := max(1, (1 << 22) // max(1, known.size))):
                d = np.sqrt(((x[at : at + step, None, :] - known[None]) ** 2).sum(axis=2))
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                n, m = order.shape
                yield pd.DataFrame({"vec_id": np.repeat(b.vec_id.to_numpy()[at : at + step], m), "label": names[order].ravel(), "rank": np.tile(np.arange(1, m + 1), n), "distance": np.take_along_axis(d, order, 1).ravel()})

    kind = prototypes.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").alias("v")).mapInPandas(run, f"vec_id long, label {kind}, rank long, distance double")


def exact(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, label, rank, distance: the k rows of ``vectors`` (vec_id, label, embedding) nearest to each of ``queries`` (vec_id, embedding), itself left out, ties by vec_id.

    Rows are dealt into shards and queries into blocks, both of bounded size; each
    pair of these is a task of its own, and the k best of each are merged. Rows
    without a vector or id aren't found, nor asked. Vectors have one length.
    """
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.where(ok).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.where(ok).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).dropDuplicates(["vec_id"])
    shards, blocks = max(1, -(-rows.count() // shard)), max(1, -(-asked.count() // block))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(of(shards).alias("shard"), every(blocks).alias("block"), "vec_id", "label", "v")
    right = asked.select(every(shards).alias("shard"), of(blocks).alias("block"), "vec_id", "v")
    names = ["query_id", "vec_id", "label", "distance"]

    def find(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asks):
            return pd.DataFrame({c: [] for c in names})
        held = held.sort_values("vec_id")
        x, ids, labels = np.stack(held.v.to_numpy()), held.vec_id.to_numpy(), held.label.to_numpy()
        square = (x**2).sum(axis=1)
        out = []
        for at in range(0, len(asks), step := max(1, (1 << 22) // len(x))):
            q, own = np.stack(asks.v.iloc[at : at + step].to_numpy()), asks.vec_id.iloc[at : at + step].to_numpy()
            rough = square[None] - 2 * q @ x.T
            rough[own[:, None] == ids[None]] = np.inf
            near = np.sort(np.partition(rough, min(k, len(x)) - 1, axis=1)[:, :k], axis=1)[:, -1]
            slack = 1e-9 * (1 + np.abs(near) + (q**2).sum(axis=1))  # rough distances choose, exact ones rank
            for i in range(len(q)):
                some = np.flatnonzero(rough[i] <= near[i] + slack[i])
                some = some[np.isfinite(rough[i][some])]
                d = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable")[:k]
                out.append((np.full(len(best), own[i]), ids[some[best]], labels[some[best]], d[best]))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(names)})

    kind = vectors.schema["label"].dataType.simpleString()
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(find, f"query_id long, vec_id long, label {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def vote(found: DataFrame, scale: float = 1.0, key: str = "vec_id") -> DataFrame:
    """``key``, label, confidence: weights 1 / (d + EPSILON) summed by label, ties by label; the confidence falls with the least distance."""
    by_label = found.groupBy(key, "label").agg(F.sum(1 / (F.col("distance") + EPSILON)).alias("weight"), F.min("distance").alias("least"))
    best = by_label.groupBy(key).agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("label").alias("label"))).alias("x"), F.min("least").alias("least"))
    return best.select(key, F.col("x.label").alias("label"), F.exp(-F.col("least") / scale).alias("confidence"))


def label_medoids(vectors: DataFrame, k: int, choice: int = CHOICE) -> DataFrame:
    """(label, vec_id): k medoids of each label. Larger labels than ``choice`` rows have candidates of the least seeded hash, and costs over all their rows."""
    spark, kind = vectors.sparkSession, vectors.schema["label"].dataType.simpleString()
    draw = F.xxhash64(F.lit(SEED), "vec_id")
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "vec_id"))
    rows = vectors.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"), draw.alias("draw")).where("v is not null")
    some = rows.withColumn("place", place).where(F.col("place") <= choice)
    big = sorted((r["label"] for r in rows.groupBy("label").count().where(F.col("count") > choice).collect()), key=lambda x: (x is not None, x))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        return pdf.loc[medoids(np.stack(pdf.v.to_numpy()), k), ["label", "vec_id"]]

    schema = f"label {kind}, vec_id long"
    if not big:
        return some.groupBy("label").applyInPandas(choose, schema)
    named = lambda part: F.broadcast(spark.createDataFrame(list(zip(part, range(len(part)))), f"name {kind}, at int"))
    every = named(big)
    out = some.join(every, F.col("label").eqNullSafe(F.col("name")), "left_anti").groupBy("label").applyInPandas(choose, schema)
    most = max(1, PROTOTYPES // choice)
    for low in range(0, len(big), most):  # so many labels at once that their candidates can go to every task
        part = big[low : low + most]
        of = lambda df: df.join(named(part), F.col("label").eqNullSafe(F.col("name")))  # noqa: B023, E731
        found: list[list] = [[] for _ in part]
        for r in of(some).select("at", "vec_id", "v").collect():
            found[r["at"]].append((r["vec_id"], r["v"]))
        found = [sorted(x) for x in found]
        chosen = _swapped(of(rows).select("at", "v"), [np.array([v for _, v in x]) for x in found], k)
        out = out.union(spark.createDataFrame([(name, x[j][0]) for name, x, c in zip(part, found, chosen) for j in sorted(c)], schema))
    return out


def _swapped(rows: DataFrame, candidates: list[np.ndarray], k: int, rounds: int = 50) -> list[list[int]]:
    """Places of the k medoids among each label's ``candidates``, as medoids() finds them, with costs over all ``rows`` (at, v): a task sums its rows for each candidate before anything moves."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(candidates)

    def costs(rests: dict[int, list[list[int]]]) -> dict:
        """For each label and each list of its medoids that stay: the cost with each candidate added."""

        def add(batches):
            total: dict = {}
            for b in batches:
                for at, v in b.groupby("at").v:
                    if at not in rests:
                        continue
                    x, c = np.stack(v.to_numpy()), sent.value[at]
                    for lo in range(0, len(x), step := max(1, (1 << 22) // max(1, c.size))):
                        d = np.sqrt(((x[lo : lo + step, None] - c[None]) ** 2).sum(axis=2))
                        for slot, rest in enumerate(rests[at]):
                            near = d[:, rest].min(axis=1)[:, None] if rest else np.inf
                            total[at, slot] = total.get((at, slot), 0) + np.minimum(near, d).sum(axis=0)
            yield pd.DataFrame([(at, slot, s.tobytes()) for (at, slot), s in total.items()], columns=["at", "slot", "s"])

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            s = np.sum(sorted((np.frombuffer(x).tolist() for x in pdf.s)), axis=0)
            return pd.DataFrame({"at": pdf["at"].iloc[:1], "slot": pdf.slot.iloc[:1], "s": [s.tobytes()]})

        ddl = "at int, slot int, s binary"
        return {(r["at"], r["slot"]): np.frombuffer(bytes(r["s"])) for r in rows.mapInPandas(add, ddl).groupBy("at", "slot").applyInPandas(whole, ddl).collect()}

    chosen: list[list[int]] = [[] for _ in candidates]
    for _ in range(k):
        new = costs({at: [c] for at, c in enumerate(chosen)})
        for at, c in enumerate(chosen):
            left = new[at, 0].copy()
            left[c] = np.inf
            if len(c) < len(left):
                c.append(int(left.argmin()))
    moving = set(range(len(chosen)))
    for _ in range(rounds):
        if not moving:
            break
        new = costs({at: [chosen[at][:i] + chosen[at][i + 1 :] for i in range(len(chosen[at]))] for at in moving})
        for at in sorted(moving):
            c = chosen[at]
            best = (new[at, 0][c[0]], None)
            for i in range(len(c)):
                j = int(new[at, i].argmin())
                if new[at, i][j] < best[0] * (1 - 1e-12) - 1e-9:
                    best = (new[at, i][j], (i, j))
            if best[1] is None:
                moving.discard(at)
            else:
                c[best[1][0]] = best[1][1]
    return chosen


def means(vectors: DataFrame, k: int, rounds: int) -> DataFrame:
    """(vec_id, cluster): k-means from the k rows of the least seeded hash. A round sums each task's rows by cluster before anything moves."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    first = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(k).collect()
    centres = np.array([r.v for r in first])
    if not len(centres):
        return rows.select("vec_id", F.lit(0).alias("cluster"))

    def own(v, centres):
        x = np.stack(v.to_numpy())
        return x, ((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None]).argmin(axis=1)

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)

        def add(batches, sent=sent):
            total, count = np.zeros_like(sent.value), np.zeros(len(sent.value))
            for b in batches:
                if len(b):
                    x, c = own(b.v, sent.value)
                    np.add.at(total, c, x)
                    count += np.bincount(c, minlength=len(count))
            yield pd.DataFrame({"cluster": np.arange(len(count)), "n": count, "s": list(total)})

        found = rows.mapInPandas(add, "cluster int, n double, s array<double>").select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        new = centres.copy()
        for r in found:
            if r.n:
                new[r.cluster, r.i] = r.x / r.n
        if np.abs(new - centres).max() < 1e-9:
            break
        centres = new
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b.vec_id, "cluster": own(b.v, sent.value)[1].astype(np.int32)})

    return rows.mapInPandas(assign, "vec_id long, cluster int")
