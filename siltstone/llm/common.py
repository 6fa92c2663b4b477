"""What the training-data operators share: shared storage, safe column access, byte words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session that runs in one process may do without it."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file:///tmp/checkpoints/siltstone"
    return own.rstrip("/")


_tables: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder. It cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _tables:
        _tables.remove(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._siltstone_path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that operators of this process have written and not removed, once their results have been read or saved."""
    for path in list(_tables):
        _delete(spark, path)


def joined_by(rows: DataFrame, classes: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``classes`` (key, count, ...), a row for each key with the number of ``rows`` that have it.

    Keys with more than an eighth of a partition's share are sent to every task, so
    that their rows stay where they are; there are eight to a partition at most.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = (classes.agg(F.sum(count)).first()[0] or 0) / (8 * partitions)
    hot, cold = classes.where(F.col(count) > most).drop(count), classes.where(F.col(count) <= most).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """Unsigned crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def bytes_of(text: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` : exactly what bytes.lower and bytes.split do."""
    return text.lower().split()


def one_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def task_partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def sorted_groups(batches: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[pa.Table]:
    """Tables of equal leading key columns out of batches that are sorted by them; whole batches at a time, cut at the last change of key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first, end = (tuple(batch.column(k)[i].as_py() for k in range(key_columns)) for i in (0, batch.num_rows - 1))
        if held and (first != last or end != last):
            cut = 0
            if first == last:  # the head still belongs to the held group
                lo, hi = 0, batch.num_rows - 1
                while lo < hi:
                    mid = (lo + hi) // 2
                    if tuple(batch.column(k)[mid].as_py() for k in range(key_columns)) == last:
                        lo = mid + 1
                    else:
                        hi = mid
                cut = lo
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
            batch = batch.slice(cut)
        held.append(batch)
        if end != first:  # give what is complete, hold the last group
            lo, hi = 0, batch.num_rows - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if tuple(batch.column(k)[mid].as_py() for k in range(key_columns)) == end:
                    hi = mid
                else:
                    lo = mid + 1
            if lo:
                yield pa.Table.from_batches([batch.slice(0, lo)])
            held = [batch.slice(lo)]
        last = end
    if held:
        yield pa.Table.from_batches(held)
