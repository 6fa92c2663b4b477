"""Extraction over a folder that files drop into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)


def extracted(spark: SparkSession, folder: str, watermark: str = "1 hour", per_trigger: int = 1000, what: str = "all") -> DataFrame:
    """Each distinct content once within the watermark, as the one result that a cache would give again; state is bounded by it."""
    files = arriving(spark, folder, per_trigger).withWatermark("modificationTime", watermark).withColumn("digest", F.sha2("content", 256))
    return extract(files.dropDuplicatesWithinWatermark(["digest"]), "content", path="path", what=what).drop("content")


def start(stream: DataFrame, target: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes to a folder of Parquet, exactly once; counters are observed as metrics of each batch."""
    counted = stream.observe("extraction", F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    writer = counted.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
