"""Queries of the format parsers and table functions over files made of base tables, with SQL over those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, textual
from ..functions.formats import DOC, DOCX, EPUB, ODP, ODS, ODT, PPTX, XLSX
from ..operators import tables
from ..operators.extract import extract
from ..operators.schema import get
from ..sources import packages as p
from . import sinks
from .detection_queries import _CHARSET, _LANG, dealt, table


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """n_regionkey, keys, names: the nations of each region in order of their keys."""
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return rows.select("n_regionkey", F.transform("x", lambda s: s["n_nationkey"].cast("long")).alias("keys"), F.transform("x", lambda s: s["n_name"]).alias("names"))


def packed(spark, sf, build) -> DataFrame:
    return regions(spark, sf).select("n_regionkey", p.made(build, F.col("keys"), F.col("names")).alias("content"))


def read(rows: DataFrame, mime: str) -> DataFrame:
    return extract(rows.withColumn("hint", F.lit(mime)), "content", hint="hint")


def text_of(key: str):
    return lambda kind="text": get(F.col("metadata"), key, kind).alias(key)


def rows_of(spark, files: DataFrame, key: str, function: str, columns: str) -> DataFrame:
    """Rows of a table function over the files, by SQL's LATERAL."""
    tables.register(spark)
    return spark.sql(f"SELECT f.{key}, {columns} FROM {{files}} f, LATERAL {function}(f.content) t", files=files)


def csv_parse(spark, sf):
    lines = F.zip_with("keys", "names", lambda k, n: F.concat(k.cast("string"), F.lit(";"), n))
    rows = regions(spark, sf).select("n_regionkey", F.concat(F.lit("n_nationkey;n_name\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return read(rows, "text/csv").select("n_regionkey", "text", text_of("column_count")("number"), text_of("row_count")("number"), text_of("delimiter")(), F.array_join(get(F.col("metadata"), "headers", "list"), "|").alias("headers"))


def json_text(spark, sf):
    return table(spark, sf, "events").select("event_id", textual.flat_json_text(F.col("props")).alias("text"), textual.json_object_sketch(F.col("props")).alias("schema_info"))


def json_parsed(spark, sf):
    rows = dealt(spark, sf, "events").select("event_id", F.col("props").alias("content"))
    return read(rows, "application/json").select("event_id", "text", text_of("schema_info")(), text_of("valid")("boolean"))


def xml_text(spark, sf):
    nodes = F.array_join(F.transform("names", lambda n: F.concat(F.lit("<nation>"), n, F.lit("</nation>"))), "")
    rows = regions(spark, sf).select("n_regionkey", F.concat(F.lit('<?xml version="1.0"?><region xmlns="urn:r"><!-- x -->'), nodes, F.lit("</region>")).alias("content"))
    return read(rows, "text/xml").select("n_regionkey", "text", textual.xml_text(F.regexp_replace("content", ' xmlns="[^"]*"', "")).alias("native_text"), text_of("root_element")(), F.array_join(get(F.col("metadata"), "namespaces", "list"), ",").alias("namespaces"))


def css_from_pages(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", textual.style_of(F.col("html")).alias("content"))
    return read(rows, "text/css").select("page_id", "text", text_of("rule_count")("number"), text_of("selector_count")("number"))


def rtf_strip(spark, sf):
    s = lambda x: F.lit(x)
    body = F.concat(s("{\\rtf1\\ansi{\\info{\\title "), "p_name", s("}{\\author "), "p_brand", s("}{\\creatim\\yr2020\\mo3\\dy"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), s("\\hr1}}{\\fonttbl{\\f0 Arial;}}\\b "), "p_name", s("\\b0\\par "), "p_type", s("\\tab "), F.col("p_size").cast("string"), s("}"))
    rows = dealt(spark, sf, "part").select("p_partkey", body.alias("content"))
    return read(rows, "application/rtf").select("p_partkey", "text", text_of("title")(), text_of("author")(), text_of("creation_date")(), text_of("rtf_version")())


def markdown_counts(spark, sf):
    s = lambda x: F.lit(x)
    body = F.concat(s("# "), "p_name", s("\n\n"), "p_type", s(" and [brand](http://x.example/"), F.col("p_partkey").cast("string"), s(")\n\n## Size\n\n```\n"), F.col("p_size").cast("string"), s("\n```\n\n![i](a.png)\n"))
    rows = dealt(spark, sf, "part").select("p_partkey", body.alias("content"))
    return read(rows, "text/markdown").select("p_partkey", text_of("title")(), *(text_of(k)("number") for k in ("heading_h1_count", "heading_h2_count", "link_count", "image_count", "code_block_count")), F.contains("text", F.col("content").substr(F.lit(3), F.instr("content", "\n") - 3)).alias("has_title"))


def zip_listing(spark, sf):
    return rows_of(spark, packed(spark, sf, p.archive_zip), "n_regionkey", "zip_entries", "t.ord, t.path, t.size, t.safe")


def zip_summary(spark, sf):
    """The parser's sums beside those of the listing."""
    m = F.col("metadata")
    rows = read(packed(spark, sf, p.archive_zip), "application/zip").select("n_regionkey", get(m, "file_count", "number").alias("file_count"), get(m, "total_size", "number").alias("total_size"), get(m, "contains_unsafe_paths", "boolean").alias("contains_unsafe_paths"), F.array_join(get(m, "files", "list"), "|").alias("files"))
    listed = zip_listing(spark, sf).groupBy("n_regionkey").agg(F.sum("size").alias("listed_size"))
    return rows.join(listed, "n_regionkey")


def tar_listing(spark, sf):
    return rows_of(spark, packed(spark, sf, p.archive_tar), "n_regionkey", "tar_entries", "t.ord, t.path, t.size, t.modified, t.safe")


def tar_summary(spark, sf):
    return read(packed(spark, sf, p.archive_tar), "application/x-tar").select("n_regionkey", "text", text_of("file_count")("number"), text_of("total_size")("number"))


def zip_bomb_guard(spark, sf):
    """Archives as groups of parts: sizes by p_size, packed sizes by price."""
    rows = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.sum(F.col("p_size").cast("long") * 2_000_000).alias("total"), F.sum(F.floor("p_retailprice") * 1000).alias("packed"))
    return rows.select("p_brand", "p_size", "total", "packed", guards.zip_bomb(F.col("total"), F.col("packed")).alias("bomb"))


def archive_members(spark, sf):
    """Required members that an archive lacks."""
    names = F.filter(F.col("names"), lambda n: ~F.contains(n, F.lit("A")))
    return regions(spark, sf).select("n_regionkey", F.array_join(F.array_sort(guards.missing_members(names, ["ALGERIA", "CHINA", "EGYPT", "PERU"])), ",").alias("missing"))


def docx_text(spark, sf):
    return read(packed(spark, sf, p.docx), DOCX).select("n_regionkey", "text", text_of("title")(), text_of("author")(), text_of("revision")("number"))


def pptx_slides(spark, sf):
    return rows_of(spark, packed(spark, sf, p.pptx), "n_regionkey", "slides", "t.slide, t.text, t.notes")


def pptx_text(spark, sf):
    return read(packed(spark, sf, p.pptx), PPTX).select("n_regionkey", "text", text_of("slide_count")("number"), text_of("has_notes")("boolean"))


def xlsx_rows(spark, sf):
    return rows_of(spark, packed(spark, sf, p.xlsx), "n_regionkey", "sheet_rows", "t.sheet, t.row, array_join(t.cells, '|') AS cells")


def xlsx_metadata(spark, sf):
    return read(packed(spark, sf, p.xlsx), XLSX).select("n_regionkey", "text", text_of("sheet_names")(), text_of("total_rows")("number"), text_of("max_columns")("number"))


def odf_text(spark, sf):
    kinds = [("odt", p.odt, ODT), ("ods", p.ods, ODS), ("odp", p.odp, ODP)]
    parts = [read(packed(spark, sf, build), mime).select("n_regionkey", F.lit(kind).alias("kind"), "text", text_of("title")(), text_of("author")()) for kind, build, mime in kinds]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def epub_text(spark, sf):
    return read(packed(spark, sf, p.epub), EPUB).select("n_regionkey", "text", text_of("title")(), text_of("author")(), text_of("spine_count")("number"))


def packages_detected(spark, sf):
    """Types of packages from their own bytes, without a hint."""
    kinds = [("docx", p.docx), ("pptx", p.pptx), ("xlsx", p.xlsx), ("odt", p.odt), ("ods", p.ods), ("odp", p.odp), ("epub", p.epub), ("zip", p.archive_zip), ("tar", p.archive_tar)]
    parts = [extract(packed(spark, sf, build), "content", what="detect").select(F.lit(kind).alias("kind"), "mime_type", "detected_by") for kind, build in kinds]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionAll(x)
    return whole.groupBy("kind", "mime_type", "detected_by").agg(F.count("*").alias("n"))


def png_texts(spark, sf):
    files = dealt(spark, sf, "part").select("p_partkey", p.made(p.png_of_part, F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("content"))
    return rows_of(spark, files, "p_partkey", "png_texts", "t.ord, t.kind, t.keyword, t.text")


def image_headers(spark, sf):
    part = dealt(spark, sf, "part")
    size = (F.col("p_partkey") % 4096 + 1), (F.col("p_partkey") % 100 + 1)
    made = {"png": p.made(p.png_of_part, F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")), "jpeg": p.made(p.jpeg, *size), "webp": p.made(p.webp, *size)}
    parts = [read(part.select("p_partkey", c.alias("content")), f"image/{kind}").select("p_partkey", F.lit(kind).alias("kind"), text_of("width")("number"), text_of("height")("number")) for kind, c in made.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def svg_counts(spark, sf):
    shapes = F.array_join(F.transform("names", lambda n: F.concat(F.lit('<rect width="1"/><text>'), n, F.lit("</text>"))), "")
    rows = regions(spark, sf).select("n_regionkey", F.concat(F.lit('<svg viewBox="0 0 9 9"><title>nations</title><g>'), shapes, F.lit("</g></svg>")).alias("content"))
    return read(rows, "image/svg+xml").select("n_regionkey", text_of("title")(), text_of("viewbox")(), text_of("element_rect_count")("number"), F.regexp_replace("text", r"\s+", " ").alias("text"))


def _place():
    k = F.col("s_suppkey")
    return k % 90, k % 60, (k * 7) % 60, k % 2 == 1


def exif_gps(spark, sf):
    d, m, s, south = _place()
    rows = dealt(spark, sf, "supplier").select("s_suppkey", p.made(p.tiff_gps, F.col("s_suppkey"), d, m, s, south).alias("content"), textual.gps_degrees(d, m, s, F.when(south, "S").otherwise("N")).alias("native"))
    return read(rows, "image/tiff").select("s_suppkey", F.round(get(F.col("metadata"), "gps_latitude", "float"), 9).alias("latitude"), F.round("native", 9).alias("native"), text_of("camera_make")(), F.date_format(get(F.col("metadata"), "datetime", "datetime"), "yyyy-MM-dd HH:mm:ss").alias("taken"))


def mp3_tags(spark, sf):
    files = dealt(spark, sf, "part").select("p_partkey", p.made(p.id3, F.col("p_name"), F.col("p_brand"), F.col("p_type"), 1950 + F.col("p_size"), F.col("p_partkey") % 90).alias("content"))
    return read(files, "audio/mpeg").select("p_partkey", text_of("title")(), text_of("artist")(), text_of("genre")(), text_of("year")("number"), text_of("track")("number"), text_of("total_tracks")("number"))


def _pdfs(spark, sf):
    return dealt(spark, sf, "part").select("p_partkey", p.made(p.pdf_of_part, F.col("p_partkey"), F.col("p_name"), F.col("p_type")).alias("content"))


def pdf_text(spark, sf):
    rows = read(_pdfs(spark, sf), "application/pdf")
    return rows.select("p_partkey", F.regexp_replace("text", r"\s+", " ").alias("text"), text_of("pdf_parse_strategy")(), text_of("pdf_version")(), text_of("page_count")("number"), text_of("title")())


def pdf_streams(spark, sf):
    return rows_of(spark, _pdfs(spark, sf), "p_partkey", "pdf_streams", "t.ord, trim(regexp_replace(t.text, '[ \\n]+', ' ')) AS text")


def ole_printable_runs(spark, sf):
    nul = lambda n: F.unhex(F.lit("00" * n))
    data = F.concat(F.unhex(F.lit("d0cf11e0a1b11ae1")), nul(512), F.encode("p_name", "UTF-8"), nul(2), F.lit("12345").cast("binary"), nul(1), F.encode("p_type", "UTF-8"), nul(120))
    rows = dealt(spark, sf, "part").select("p_partkey", data.alias("content"))
    return read(rows, DOC).select("p_partkey", "text", textual.printable_runs(F.col("content")).alias("native_text"))


def _sunk(spark, sf):
    rows = table(spark, sf, "region").select("r_regionkey", F.concat("r_name", F.lit("\nx")).alias("content"))
    return read(rows, "text/plain")


def sink_text(spark, sf):
    return _sunk(spark, sf).select("r_regionkey", sinks.text(F.col("mime_type"), F.col("detection_confidence"), F.col("metadata"), F.col("text")).alias("shown"))


def sink_json(spark, sf):
    return _sunk(spark, sf).select("r_regionkey", sinks.json(F.col("mime_type"), F.col("detection_confidence"), F.col("metadata"), F.col("text")).alias("shown"))


def metadata_keys(spark, sf):
    rows = extract(table(spark, sf, "pages").select("page_id", "html"), "html", what="metadata")
    return rows.select(F.explode(F.map_keys("metadata")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_N = "(SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)"
_JOINED = lambda sep: f"string_agg(n_name, {sep} ORDER BY n_nationkey)"
_FIRST = "arg_min(n_name, n_nationkey)"
_GROUP = f"FROM {_N} GROUP BY n_regionkey"

QUERIES = {
    f.__name__: f
    for f in (
        csv_parse, json_text, json_parsed, xml_text, css_from_pages, rtf_strip, markdown_counts, zip_listing, zip_summary, tar_listing, tar_summary, zip_bomb_guard, archive_members, docx_text,
        pptx_slides, pptx_text, xlsx_rows, xlsx_metadata, odf_text, epub_text, packages_detected, png_texts, image_headers, svg_counts, exif_gps, mp3_tags, pdf_text, pdf_streams,
        ole_printable_runs, sink_text, sink_json, metadata_keys,
    )
}

_JSON = "array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), chr(10))"
_SKETCH = "'object{' || array_to_string(list_sort(json_keys(props)), ', ') || '}'"
_CSS = "array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10))"
_LAT = "(CASE WHEN s_suppkey % 2 = 1 THEN -1 ELSE 1 END) * (s_suppkey % 90 + CAST(s_suppkey % 60 AS DOUBLE) / 60 + CAST((s_suppkey * 7) % 60 AS DOUBLE) / 3600)"

ORACLE = {
    "csv_parse": f"SELECT n_regionkey, 'n_nationkey, n_name' || chr(10) || string_agg(n_nationkey || ', ' || n_name, chr(10) ORDER BY n_nationkey) AS text, CAST(2 AS BIGINT) AS column_count, count(*) AS row_count, 'semicolon' AS delimiter, 'n_nationkey|n_name' AS headers {_GROUP}",
    "json_text": f"SELECT event_id, {_JSON} AS text, {_SKETCH} AS schema_info FROM events",
    "json_parsed": f"SELECT event_id, {_JSON} AS text, {_SKETCH} AS schema_info, true AS valid FROM events",
    "xml_text": f"SELECT n_regionkey, {_JOINED(chr(39) + ' ' + chr(39))} AS text, {_JOINED(chr(39) + ' ' + chr(39))} AS native_text, 'region' AS root_element, 'urn:r' AS namespaces {_GROUP}",
    "css_from_pages": f"SELECT page_id, css AS text, CAST(len(regexp_extract_all(css, '[{{]')) AS BIGINT) AS rule_count, CAST(coalesce(list_sum(list_transform(regexp_extract_all(css, '[^{{}}]+[{{]'), lambda s: 1 + length(s) - length(replace(s, ',', '')))), 0) AS BIGINT) AS selector_count FROM (SELECT page_id, {_CSS} AS css FROM pages)",
    "rtf_strip": "SELECT p_partkey, p_name || chr(10) || p_type || chr(9) || p_size AS text, p_name AS title, p_brand AS author, '2020-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS creation_date, '1' AS rtf_version FROM part",
    "markdown_counts": "SELECT p_partkey, p_name AS title, CAST(1 AS BIGINT) AS heading_h1_count, CAST(1 AS BIGINT) AS heading_h2_count, CAST(1 AS BIGINT) AS link_count, CAST(1 AS BIGINT) AS image_count, CAST(1 AS BIGINT) AS code_block_count, true AS has_title FROM part",
    "zip_listing": f"SELECT n_regionkey, CAST(i - 1 AS INTEGER) AS ord, 'nation/' || n_name || '.txt' AS path, CAST(length(n_name) * n_nationkey AS BIGINT) AS size, true AS safe FROM {_N}",
    "zip_summary": f"SELECT n_regionkey, count(*) AS file_count, CAST(sum(length(n_name) * n_nationkey) AS BIGINT) AS total_size, false AS contains_unsafe_paths, string_agg('nation/' || n_name || '.txt', '|' ORDER BY n_nationkey) AS files, CAST(sum(length(n_name) * n_nationkey) AS BIGINT) AS listed_size {_GROUP}",
    "tar_listing": f"SELECT n_regionkey, CAST(i - 1 AS INTEGER) AS ord, 'nation/' || n_name || '.txt' AS path, CAST(length(n_name) * n_nationkey AS BIGINT) AS size, strftime(make_timestamp((1000000000 + CAST(n_nationkey AS BIGINT) * 86400) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS modified, true AS safe FROM {_N}",
    "tar_summary": f"SELECT n_regionkey, 'TAR Archive Contents (' || count(*) || ' files):' || chr(10) || string_agg('nation/' || n_name || '.txt (' || length(n_name) * n_nationkey || ' bytes)', chr(10) ORDER BY n_nationkey) AS text, count(*) AS file_count, CAST(sum(length(n_name) * n_nationkey) AS BIGINT) AS total_size {_GROUP}",
    "zip_bomb_guard": "SELECT p_brand, p_size, total, packed, total > 524288000 OR (packed > 0 AND CAST(total AS DOUBLE) / packed > 100) AS bomb FROM (SELECT p_brand, p_size, CAST(sum(CAST(p_size AS BIGINT) * 2000000) AS BIGINT) AS total, CAST(sum(floor(p_retailprice) * 1000) AS BIGINT) AS packed FROM part GROUP BY p_brand, p_size)",
    "archive_members": "SELECT n_regionkey, coalesce(string_agg(m, ',' ORDER BY m) FILTER (WHERE n_name IS NULL), '') AS missing FROM (SELECT DISTINCT n_regionkey FROM nation) r CROSS JOIN (VALUES ('ALGERIA'), ('CHINA'), ('EGYPT'), ('PERU')) v(m) LEFT JOIN (SELECT n_regionkey AS k, n_name FROM nation WHERE NOT contains(n_name, 'A')) n ON n.k = n_regionkey AND n_name = m GROUP BY n_regionkey",
    "docx_text": f"SELECT n_regionkey, {_JOINED('chr(10)')} AS text, count(*) || ' nations' AS title, {_FIRST} AS author, CAST(7 AS BIGINT) AS revision {_GROUP}",
    "pptx_slides": f"SELECT n_regionkey, CAST(i AS INTEGER) AS slide, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'about ' || n_name ELSE '' END AS notes FROM {_N}",
    "pptx_text": f"SELECT n_regionkey, string_agg('--- Slide ' || i || ' ---' || chr(10) || n_name || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || 'Speaker Notes:' || chr(10) || 'about ' || n_name ELSE '' END, chr(10) || chr(10) ORDER BY n_nationkey) AS text, count(*) AS slide_count, bool_or(n_nationkey % 2 = 0) AS has_notes {_GROUP}",
    "xlsx_rows": f"SELECT n_regionkey, 'Nations' AS sheet, CAST(i - 1 AS INTEGER) AS row, n_nationkey || '|' || n_name AS cells FROM {_N}",
    "xlsx_metadata": f"SELECT n_regionkey, '=== Sheet: Nations ===' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS text, 'Nations' AS sheet_names, count(*) AS total_rows, CAST(2 AS BIGINT) AS max_columns {_GROUP}",
    "odf_text": f"""SELECT n_regionkey, 'odt' AS kind, {_JOINED('chr(10)')} AS text, 'nations' AS title, 'someone' AS author {_GROUP}
      UNION ALL SELECT n_regionkey, 'ods', '=== Table: Nations ===' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey), 'nations', 'someone' {_GROUP}
      UNION ALL SELECT n_regionkey, 'odp', string_agg('--- Slide ' || i || ' ---' || chr(10) || n_name, chr(10) || chr(10) ORDER BY n_nationkey), 'nations', 'someone' {_GROUP}""",
    "epub_text": f"SELECT n_regionkey, string_agg(n_name, ' ' || chr(10) || chr(10) || chr(10) ORDER BY n_nationkey) AS text, 'Nations' AS title, {_FIRST} AS author, count(*) AS spine_count {_GROUP}",
    "packages_detected": f"SELECT kind, mime_type, 'magic_bytes' AS detected_by, count(DISTINCT n_regionkey) AS n FROM nation, (VALUES ('docx', '{DOCX}'), ('pptx', '{PPTX}'), ('xlsx', '{XLSX}'), ('odt', '{ODT}'), ('ods', '{ODS}'), ('odp', '{ODP}'), ('epub', '{EPUB}'), ('zip', 'application/zip'), ('tar', 'application/x-tar')) v(kind, mime_type) GROUP BY kind, mime_type",
    "png_texts": "SELECT p_partkey, ord, kind, keyword, CASE ord WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS text FROM part, (VALUES (0, 'tEXt', 'Title'), (1, 'zTXt', 'Brand'), (2, 'iTXt', 'Type')) v(ord, kind, keyword)",
    "image_headers": "SELECT p_partkey, kind, CAST(p_partkey % 4096 + 1 AS BIGINT) AS width, CAST(p_partkey % 100 + 1 AS BIGINT) AS height FROM part, (VALUES ('png'), ('jpeg'), ('webp')) v(kind)",
    "svg_counts": f"SELECT n_regionkey, 'nations' AS title, '0 0 9 9' AS viewbox, count(*) AS element_rect_count, {_JOINED(chr(39) + ' ' + chr(39))} AS text {_GROUP}",
    "exif_gps": f"SELECT s_suppkey, round({_LAT}, 9) AS latitude, round({_LAT}, 9) AS native, 'Maker ' || s_suppkey AS camera_make, '2020-01-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') || ' 03:04:05' AS taken FROM supplier",
    "mp3_tags": "SELECT p_partkey, p_name AS title, p_brand AS artist, p_type AS genre, CAST(1950 + p_size AS BIGINT) AS year, CAST(p_partkey % 90 AS BIGINT) AS track, CAST(99 AS BIGINT) AS total_tracks FROM part",
    "pdf_text": "SELECT p_partkey, p_name || ' ' || p_type AS text, CASE WHEN p_partkey % 3 = 0 THEN 'raw_scan' ELSE 'strict' END AS pdf_parse_strategy, '1.5' AS pdf_version, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1 AS BIGINT) END AS page_count, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title FROM part",
    "pdf_streams": "SELECT p_partkey, 0 AS ord, p_name || ' ' || p_type AS text FROM part",
    "ole_printable_runs": "SELECT p_partkey, p_name || ' ' || p_type AS text, p_name || ' ' || p_type AS native_text FROM part",
    "metadata_keys": f"""WITH k AS (SELECT {_CHARSET} <> '' AS charset, {_LANG} <> '' AS language, regexp_matches(html, '(?is)<title[^>]*>.*?</title>') AS title, {', '.join(f"regexp_matches(html, '(?i)<h{k}[\\s>]') AS heading_h{k}_count" for k in range(1, 7))} FROM pages)
      SELECT key, n FROM (SELECT {', '.join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in ('charset', 'language', 'title', *(f'heading_h{k}_count' for k in range(1, 7))))} FROM k) UNPIVOT (n FOR key IN (charset, language, title, {', '.join(f'heading_h{k}_count' for k in range(1, 7))})) WHERE n > 0""",
    "sink_json": """SELECT r_regionkey, '{"mime_type":"text/plain","detection_confidence":1.0,"metadata":{"fields":{"character_count":{"Number":' || (length(r_name) + 2) || '},"encoding":{"Text":"UTF-8"},"line_count":{"Number":2}}},"content":"' || r_name || '\\nx"}' AS shown FROM region""",
    "sink_text": "SELECT r_regionkey, 'MIME Type: text/plain' || chr(10) || 'Detection Confidence: 1.00' || chr(10) || chr(10) || 'Metadata:' || chr(10) || '  character_count: ' || (length(r_name) + 2) || chr(10) || '  encoding: UTF-8' || chr(10) || '  line_count: 2' || chr(10) || chr(10) || 'Content:' || chr(10) || r_name || chr(10) || 'x' || chr(10) AS shown FROM region",
}
