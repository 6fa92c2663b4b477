"""Native twins of text parsers, for inputs of known shape: no Python runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_json_text(text: Column) -> Column:
    """``key: value`` lines of a flat JSON object, keys in order; null for what isn't one."""
    keys = F.array_sort(F.json_object_keys(text))
    values = F.from_json(text, "map<string,string>")
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at(values, k))), "\n")


def json_object_sketch(text: Column) -> Column:
    """``object{k1, k2}`` of a JSON object, keys in order."""
    return F.concat(F.lit("object{"), F.array_join(F.array_sort(F.json_object_keys(text)), ", "), F.lit("}"))


def xml_text(text: Column) -> Column:
    """Text nodes of an XML document, joined by a blank."""
    return F.array_join(F.xpath(text, F.lit("//text()")), " ")


def style_of(html: Column) -> Column:
    """What the style elements of a page hold, joined by line feeds."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")


def gps_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees, negative for south and west."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def printable_runs(data: Column) -> Column:
    """Readable runs of a binary document, three characters at least and half of them letters, as one line."""
    runs = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(r"[\x20-\x7E\n\r\t]{3,}"), F.lit(0))
    likely = F.filter(runs, lambda s: F.regexp_count(s, F.lit("[A-Za-z]")) >= F.length(s) * 0.5)
    return F.trim(F.regexp_replace(F.array_join(likely, " "), r"\s+", " "))
