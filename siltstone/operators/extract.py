"""Detection, routing and extraction over any column of bytes.

Types are found by native expressions; one Arrow-batched function then runs the
parser of each row's type. Rows whose result can't be used (unknown types, inputs
that are too large) never hand their bytes to Python. What goes wrong in a row is
a value of that row, never an exception of the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect as d
from ..functions import guards
from .ocr import engine
from .parsers.base import Failure
from .registry import parser_of, supported
from .schema import PARSED, tagged

#: Largest input that any parser is given.
LIMIT = 100 << 20
#: Tasks a core, and at least, among which ``spread`` deals out rows.
TASKS_A_CORE, TASKS = 3, 24
#: Rows and bytes of an Arrow batch that a parser is given, and with their results the most that a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def parse(data: bytes, mime: str, metadata_only: bool = False, ocr: engine.Config | None = None) -> dict:
    """Text, metadata and error of one input; images are read by an engine that is switched on."""
    out: dict = {"text": None, "metadata": {}, "error": None}
    parser = parser_of(mime)
    if parser is None:
        return out | {"error": {"kind": "UnsupportedFormat", "message": f"no parser reads {mime}"}}
    try:
        text, metadata = engine.with_text(mime, data, *parser(data), ocr)
    except Failure as e:
        return out | {"error": {"kind": e.kind, "message": str(e)}}
    except Exception as e:  # a parser's own slip is that row's error
        return out | {"error": {"kind": "ParseError", "message": f"{type(e).__name__}: {e}"}}
    clean = lambda s: s.encode("utf-8", "replace").decode()  # noqa: E731  no lone surrogates
    return out | {"text": None if metadata_only or text is None else clean(text), "metadata": {clean(str(k)): tagged(clean(v) if isinstance(v, str) else v) for k, v in metadata.items()}}


def parsed(data: Column, mime: Column, metadata_only: bool = False, ocr: engine.Config | None = None) -> Column:
    """struct<text, metadata, error> of bytes by their type."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, mimes in batches:
            yield pd.DataFrame([parse(b, m, metadata_only, ocr) if b is not None and m is not None else {"text": None, "metadata": None, "error": None} for b, m in zip(data, mimes)], columns=["text", "metadata", "error"])

    return run(data, mime)


def extract(df: DataFrame, data: str = "content", path: str | None = None, hint: str | None = None, what: str = "all", limit: int = LIMIT, ocr: engine.Config | None = None) -> DataFrame:
    """The rows of ``df`` with mime_type, detection_confidence, detected_by, and, as ``what`` asks, text, metadata and error.

    ``what``: detect (nothing is parsed), metadata, text, or all. A row with a hint
    isn't looked at to find its type. Null bytes have no type and no result. ``ocr`` is
    an engine for images; without one, the session's settings say whether and how
    they are read (``siltstone.ocr``, off by default).
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ocr = ocr or engine.configured(lambda k: conf.get(k, None))
    bytes_ = F.col(data).cast("binary")
    size = F.octet_length(bytes_)
    found = d.detect_with_hint(bytes_, F.col(hint)) if hint else d.detect(bytes_, F.col(path) if path else None, head_only=path is not None)
    out = df.withColumn("_found", found)
    for column, field in (("mime_type", "mime_type"), ("detection_confidence", "confidence"), ("detected_by", "detected_by")):
        out = out.withColumn(column, F.col("_found")[field])
    out = out.drop("_found")
    if what == "detect":
        return out
    big = (size > limit) | guards.too_large(F.col("mime_type"), size)
    known = F.col("mime_type").isin(supported())
    out = out.withColumn("_parsed", parsed(F.when(known & ~big, bytes_), F.when(known & ~big, F.col("mime_type")), what == "metadata", ocr if ocr.enabled else None))
    error = lambda kind, message: F.struct(F.lit(kind).alias("kind"), message.alias("message"))
    refused = F.when(size.isNull(), None).when(~known, error("UnsupportedFormat", F.concat(F.lit("no parser reads "), F.col("mime_type")))).when(big, error("Io", F.concat(size.cast("string"), F.lit(" bytes are more than are read"))))
    if what in ("all", "text"):
        out = out.withColumn("text", F.col("_parsed.text"))
    if what in ("all", "metadata"):
        out = out.withColumn("metadata", F.col("_parsed.metadata"))
    return out.withColumn("error", F.coalesce(refused, F.col("_parsed.error"))).drop("_parsed")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt out evenly to several tasks a core.

    A table of short rows is one small file, which one or two tasks read, however
    many rows it has; all work in Python on its rows would stay in these tasks.
    """
    return rows.repartition(max(TASKS, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism))


def batch_summary(extracted: DataFrame) -> DataFrame:
    """One row: how many inputs there were, how many were read, how many failed."""
    return extracted.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(m,) for m in supported()], "mime_type string")
