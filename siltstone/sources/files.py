"""Files and byte columns as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import LIMIT, extract

CHUNK = 64 << 10


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths)


def extract_files(spark: SparkSession, paths: str | list[str], what: str = "all", **options) -> DataFrame:
    return extract(read_files(spark, paths, **options), "content", path="path", what=what)


def within_limit(size: Column, limit: int = LIMIT) -> Column:
    """An input of exactly the limit is within it."""
    return size <= limit


def chunks(df: DataFrame, data: str, size: int = CHUNK, limit: int | None = None) -> DataFrame:
    """Rows of at most ``size`` bytes (or characters of a text) of each row, with their ordinal; with a limit, none of a row beyond it."""
    length = F.length(F.col(data))
    rows = df if limit is None else df.where(length <= limit)
    last = F.floor((length - 1) / size).cast("int")
    out = rows.where(length > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("chunk", F.substring(F.col(data), F.col("chunk_no") * size + 1, F.lit(size)))
