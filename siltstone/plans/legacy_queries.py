"""Queries of binary office files, detection by path and by masks, packed PDF streams and YAML, over files made of base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect as d
from ..functions.formats import DOC, PPT, XLS
from ..operators.extract import extract
from ..operators.schema import get
from ..sources import packages as p
from . import sinks
from .detection_queries import dealt, found_sql, table

#: Stream names that tell the types of compound files apart.
STREAMS = (("WordDocument", DOC), ("Workbook", XLS), ("Book", XLS), ("PowerPoint Document", PPT), ("Current User", PPT))


def _read(rows, mime: str):
    return extract(rows.withColumn("hint", F.lit(mime)), "content", hint="hint")


def _nul(n: int):
    return F.unhex(F.lit("00" * n))


def ole_detected(spark, sf):
    """Compound files with one stream name, as ASCII or UTF-16LE."""
    k = F.col("p_partkey") % (2 * len(STREAMS))
    names = F.element_at(F.array(*[F.lit(bytearray(n.encode(c))) for n, _ in STREAMS for c in ("ascii", "utf-16-le")]), (k + 1).cast("int"))
    data = F.concat(F.unhex(F.lit("d0cf11e0a1b11ae1")), _nul(600), names, _nul(50), F.encode("p_name", "UTF-8"))
    found = extract(dealt(spark, sf, "part").select("p_partkey", data.alias("content")), "content", what="detect")
    return found.select("p_partkey", "mime_type", F.round(F.col("detection_confidence").cast("double"), 4).alias("confidence"), "detected_by")


def detect_path(spark, sf):
    """By path only the first 8 KiB are looked at, and the extension where they say nothing."""
    k, n = F.col("doc_id") % 4, F.octet_length("text")
    body = F.when(k < 2, F.concat(F.lit(' {"a": "'), F.repeat(F.lit("x"), F.least(n, F.lit(20_000)).cast("int")), F.lit('"}'))).otherwise("")
    path = F.concat(F.lit("/in/d.1/f"), F.col("doc_id").cast("string"), F.when(k == 2, ".MD").when(k == 3, ".what").otherwise(".bin"))
    found = extract(table(spark, sf, "documents").select("doc_id", body.cast("binary").alias("content"), path.alias("path")), "content", path="path", what="detect")
    return found.select("doc_id", "path", "mime_type", "detected_by")


def masked_signature(spark, sf):
    """Two letters whatever their case, by a mask of their bits."""
    data = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", d.masked_at(data, 0, b"TH", b"\xdf\xdf").alias("th"), d.masked_at(data, 1, b"E", b"\xdf").alias("e"))


def _books(spark, sf):
    columns = [F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")]
    return dealt(spark, sf, "part").select("p_partkey", p.made(p.xls_of_part, *columns).alias("content"))


def xls_text(spark, sf):
    m = F.col("metadata")
    return _read(_books(spark, sf), XLS).select("p_partkey", "text", get(m, "sheet_names").alias("sheet_names"), get(m, "total_rows", "number").alias("total_rows"), get(m, "max_columns", "number").alias("max_columns"))


def xls_detected(spark, sf):
    return extract(_books(spark, sf), "content", what="detect").groupBy("mime_type", "detected_by").agg(F.count("*").alias("n"))


def ppt_text(spark, sf):
    """Readable runs of a presentation; what isn't mostly letters is left out."""
    data = F.concat(F.unhex(F.lit("d0cf11e0a1b11ae1")), _nul(600), F.encode("p_name", "UTF-8"), _nul(3), F.lit("12345 67").cast("binary"), _nul(2), F.encode("p_type", "UTF-8"), _nul(120))
    return _read(dealt(spark, sf, "part").select("p_partkey", data.alias("content")), PPT).select("p_partkey", "text", F.col("error.kind").alias("error_kind"))


def pdf_packed(spark, sf):
    """Streams packed by LZW, base-85 digits, or both."""
    files = dealt(spark, sf, "part").select("p_partkey", p.made(p.pdf_packed, F.col("p_partkey"), F.col("p_name"), F.col("p_type")).alias("content"))
    return _read(files, "application/pdf").select("p_partkey", F.regexp_replace("text", r"\s+", " ").alias("text"), get(F.col("metadata"), "pdf_parse_strategy").alias("strategy"))


def sink_yaml(spark, sf):
    rows = dealt(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("\nx")).alias("content"))
    return _read(rows, "text/plain").select("p_partkey", sinks.yaml(F.col("mime_type"), F.col("detection_confidence"), F.col("metadata"), F.col("text")).alias("shown"))


def sink_detection_yaml(spark, sf):
    x = d.detect(F.col("text").cast("binary"), archives=False)
    return table(spark, sf, "documents").select("doc_id", x.alias("x")).select("doc_id", sinks.detection_yaml(F.col("x")).alias("shown"))


QUERIES = {f.__name__: f for f in (ole_detected, detect_path, masked_signature, xls_text, xls_detected, ppt_text, pdf_packed, sink_yaml, sink_detection_yaml)}

_PRICE = "CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END"
_LENGTH = "10 + least(strlen(text), 20000)"

ORACLE = {
    "ole_detected": "SELECT p_partkey, CASE (p_partkey % 10) // 2 " + " ".join(f"WHEN {k} THEN '{m}'" for k, (_, m) in enumerate(STREAMS)) + " END AS mime_type, CAST(0.9 AS DOUBLE) AS confidence, 'magic_bytes' AS detected_by FROM part",
    "detect_path": f"""SELECT doc_id, '/in/d.1/f' || doc_id || CASE doc_id % 4 WHEN 2 THEN '.MD' WHEN 3 THEN '.what' ELSE '.bin' END AS path,
      CASE WHEN doc_id % 4 = 2 THEN 'text/markdown' WHEN doc_id % 4 = 3 THEN 'application/octet-stream' WHEN {_LENGTH} <= 8192 THEN 'application/json' ELSE 'text/plain' END AS mime_type,
      CASE doc_id % 4 WHEN 2 THEN 'extension' WHEN 3 THEN 'unknown' ELSE 'content_analysis' END AS detected_by FROM documents""",
    "masked_signature": "SELECT doc_id, strlen(text) >= 2 AND lower(substr(text, 1, 2)) = 'th' AS th, CASE WHEN strlen(text) < 2 THEN false ELSE substr(hex(encode(substr(text, 1, 2))), 3, 2) IN ('45', '65') END AS e FROM documents",
    "xls_text": f"""SELECT p_partkey, '=== Sheet: Parts ===' || chr(10) || 'key,name,size,large,price' || chr(10) || p_name || ',' || p_brand || ',' || p_size || ',' || (p_size > 25) || ',' || {_PRICE} || chr(10)
      || p_partkey || ',' || p_name || ',-' || p_size || ',false,' || CAST(floor(p_retailprice) AS BIGINT) || chr(10) AS text, 'Parts' AS sheet_names, CAST(3 AS BIGINT) AS total_rows, CAST(5 AS BIGINT) AS max_columns FROM part""",
    "xls_detected": f"SELECT '{XLS}' AS mime_type, 'magic_bytes' AS detected_by, count(*) AS n FROM part",
    "ppt_text": "SELECT p_partkey, p_name || ' ' || p_type AS text, CAST(NULL AS VARCHAR) AS error_kind FROM part",
    "pdf_packed": "SELECT p_partkey, p_name || ' ' || p_type AS text, 'strict' AS strategy FROM part",
    "sink_yaml": """SELECT p_partkey, 'mime_type: "text/plain"' || chr(10) || 'detection_confidence: 1.0' || chr(10) || 'metadata:' || chr(10) || '  fields:' || chr(10) || '    "character_count":' || chr(10) || '      Number: ' || (length(p_name) + 2) || chr(10)
      || '    "encoding":' || chr(10) || '      Text: "UTF-8"' || chr(10) || '    "line_count":' || chr(10) || '      Number: 2' || chr(10) || 'content: "' || p_name || '\\nx"' || chr(10) AS shown FROM part""",
    "sink_detection_yaml": f"SELECT doc_id, 'mime_type: \"' || mime_type || '\"' || chr(10) || 'confidence: ' || confidence || chr(10) || 'detected_by: ' || detected_by || chr(10) AS shown FROM ({found_sql('documents', 'doc_id', 'text')})",
}
