"""Text, JSON and YAML forms of results, as native columns; write them with the usual writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.schema import shown


def save(shown: DataFrame, column: str, path: str) -> None:
    """Writes the texts of a column, as made here, to a folder of text files, one result after another; what was there is replaced."""
    shown.select(F.regexp_replace(F.col(column), "\n$", "").alias("value")).write.mode("overwrite").text(path)


def metadata_block(metadata: Column) -> Column:
    entries = F.array_sort(F.map_entries(metadata), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), shown(e["value"])))
    return F.when(F.size(metadata) > 0, F.array_join(lines, "\n")).otherwise("  (none)")


def text(mime: Column, confidence: Column, metadata: Column, content: Column, metadata_only: bool = False) -> Column:
    head = F.concat(F.lit("MIME Type: "), mime, F.lit("\nDetection Confidence: "), F.format_string("%.2f", confidence.cast("double")), F.lit("\n\nMetadata:\n"), metadata_block(metadata), F.lit("\n"))
    return head if metadata_only else F.concat(head, F.lit("\nContent:\n"), F.coalesce(content, F.lit("[No content extracted]")), F.lit("\n"))


def _external(v: Column) -> Column:
    """A metadata value with its kind as the only key, as JSON text."""
    one = lambda name, x: F.to_json(F.struct(x.alias(name)))
    items = F.transform(v["list"], lambda s: F.struct(s.alias("Text")))
    return (
        F.when(v["tag"] == "text", one("Text", v["text"])).when(v["tag"] == "number", one("Number", v["number"])).when(v["tag"] == "float", one("Float", v["float"]))
        .when(v["tag"] == "boolean", one("Boolean", v["boolean"])).when(v["tag"] == "datetime", one("DateTime", F.date_format(v["datetime"], "yyyy-MM-dd'T'HH:mm:ss'Z'"))).otherwise(one("List", items))
    )


def json(mime: Column, confidence: Column, metadata: Column, content: Column, metadata_only: bool = False) -> Column:
    entries = F.array_sort(F.transform(F.map_entries(metadata), lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit("\0"), _external(e["value"]))))
    fields = F.transform(entries, lambda s: F.concat(F.regexp_extract(s, "(?s)^\\[(.*)\\]\0", 1), F.lit(":"), F.regexp_extract(s, "(?s)\0(.*)$", 1)))
    parts = [F.lit('{"mime_type":'), _quoted(mime), F.lit(',"detection_confidence":'), confidence.cast("string"), F.lit(',"metadata":{"fields":{'), F.array_join(fields, ","), F.lit("}}")]
    if not metadata_only:
        parts += [F.lit(',"content":'), F.coalesce(_quoted(content), F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def _quoted(x: Column) -> Column:
    """A text as a JSON string, which is a double-quoted scalar of YAML as well."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def _block(v: Column) -> Column:
    """A metadata value with its kind as the only key, as YAML below a field."""
    one = lambda kind, x: F.concat(F.lit(f"{kind}: "), x)
    items = F.concat(F.lit("List:\n"), F.array_join(F.transform(v["list"], lambda s: F.concat(F.lit("      - Text: "), _quoted(s))), "\n"))
    return (
        F.when(v["tag"] == "text", one("Text", _quoted(v["text"]))).when(v["tag"] == "number", one("Number", v["number"].cast("string"))).when(v["tag"] == "float", one("Float", v["float"].cast("string")))
        .when(v["tag"] == "boolean", one("Boolean", v["boolean"].cast("string"))).when(v["tag"] == "datetime", one("DateTime", _quoted(F.date_format(v["datetime"], "yyyy-MM-dd'T'HH:mm:ss'Z'"))))
        .otherwise(F.when(F.size(v["list"]) > 0, items).otherwise("List: []"))
    )


def yaml(mime: Column, confidence: Column, metadata: Column, content: Column, metadata_only: bool = False) -> Column:
    """The same fields as json() as a block of YAML; fields in order of their names."""
    entries = F.array_sort(F.map_entries(metadata), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    fields = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("    "), _quoted(e["key"]), F.lit(":\n      "), _block(e["value"]))), "\n")
    parts = [F.lit("mime_type: "), _quoted(mime), F.lit("\ndetection_confidence: "), confidence.cast("string"), F.lit("\nmetadata:\n  fields:"), F.when(F.size(metadata) > 0, F.concat(F.lit("\n"), fields)).otherwise(" {}"), F.lit("\n")]
    if not metadata_only:
        parts += [F.lit("content: "), F.coalesce(_quoted(content), F.lit("null")), F.lit("\n")]
    return F.concat(*parts)


def detection_yaml(found: Column) -> Column:
    return F.concat(F.lit("mime_type: "), _quoted(found["mime_type"]), F.lit("\nconfidence: "), found["confidence"].cast("string"), F.lit("\ndetected_by: "), found["detected_by"], F.lit("\n"))


_SHOWN = {"magic_bytes": "MagicBytes", "content_analysis": "ContentAnalysis", "extension": "Extension", "unknown": "Unknown"}


def detection_text(found: Column) -> Column:
    name = F.try_element_at(F.create_map(*[F.lit(x) for p in _SHOWN.items() for x in p]), found["detected_by"])
    return F.concat(F.lit("MIME Type: "), found["mime_type"], F.lit("\nConfidence: "), F.format_string("%.2f", found["confidence"].cast("double")), F.lit("\nDetected By: "), name)


def detection_json(found: Column) -> Column:
    return F.concat(F.lit('{"mime_type":"'), found["mime_type"], F.lit('","confidence":'), found["confidence"].cast("string"), F.lit(',"detected_by":"'), found["detected_by"], F.lit('"}'))
