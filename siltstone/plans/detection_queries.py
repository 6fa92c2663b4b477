"""Queries of detection, routing, guards and text metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as d
from ..functions import guards
from ..functions.formats import EXTENSIONS, SIGNATURES, SIZE_LIMITS
from ..operators.extract import batch_summary, catalogue, extract, spread
from ..operators.registry import supported
from ..sources.files import chunks
from . import sinks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of short rows of which Python makes or reads something."""
    return spread(table(spark, sf_dir, name))


def _found(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Detection of a text column. Strings can't be archives' bytes, so no Python is needed."""
    x = d.detect(F.col(text).cast("binary"), archives=False)
    return df.select(*key, x.alias("x")).select(*key, F.col("x.mime_type").alias("mime_type"), F.round(F.col("x.confidence").cast("double"), 4).alias("confidence"), F.col("x.detected_by").alias("detected_by"))


def detect_pages(spark, sf):
    return _found(table(spark, sf, "pages"), ["page_id"], "html")


def detect_documents(spark, sf):
    return _found(table(spark, sf, "documents"), ["doc_id"], "text")


def detect_props(spark, sf):
    return _found(table(spark, sf, "events"), ["event_id"], "props")


def detect_conversations(spark, sf):
    return _found(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")


def detect_summary(spark, sf):
    parts = [_found(table(spark, sf, t), [], c) for t, c in (("pages", "html"), ("documents", "text"), ("events", "props"), ("conversations", "text"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.groupBy("mime_type", "detected_by").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def detect_magic_table(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return d.detect_by_join(rows, "data").select("doc_id", F.col("magic.mime").alias("mime_type"), F.col("magic.ord").alias("ord"))


def detect_extension(spark, sf):
    names = sorted(EXTENSIONS)
    ext = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/v1.0/f"), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 2 == 0, F.upper(ext)).otherwise(ext)).alias("path"))
    return docs.select("doc_id", "path", d.by_extension(F.col("path")).alias("mime_type"))


def detect_with_hint(spark, sf):
    hint = F.when(F.col("doc_id") % 2 == 0, "text/plain")
    x = d.detect_with_hint(F.col("text").cast("binary"), hint, archives=False)
    return table(spark, sf, "documents").select("doc_id", x.alias("x")).select("doc_id", F.col("x.mime_type").alias("mime_type"), F.col("x.detected_by").alias("detected_by"))


def confidence_context(spark, sf):
    size = F.octet_length("text")
    value = d.confidence_in_context(F.lit(0.7), F.col("doc_id") % 3 == 0, size)
    return table(spark, sf, "documents").select("doc_id", size.cast("long").alias("bytes"), F.round(value, 6).alias("confidence"))


def encoding_sniff(spark, sf):
    marked = F.concat(F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("EFBBBF"))).when(F.col("doc_id") % 4 == 1, F.unhex(F.lit("FFFE"))).when(F.col("doc_id") % 4 == 2, F.unhex(F.lit("FEFF"))).otherwise(F.unhex(F.lit(""))),
                      F.when(F.col("doc_id") % 4 == 1, F.encode("text", "UTF-16LE")).when(F.col("doc_id") % 4 == 2, F.encode("text", "UTF-16BE")).otherwise(F.col("text").cast("binary")))
    rows = table(spark, sf, "documents").select("doc_id", marked.alias("data"))
    return rows.select("doc_id", d.encoding(F.col("data")).alias("encoding"), F.length(d.decoded(F.col("data"))).cast("long").alias("n_chars"))


def supported_formats(spark, sf):
    return catalogue(spark)


def unsupported_rows(spark, sf):
    """Rows whose detected type no parser reads."""
    parts = [_found(table(spark, sf, t), [F.lit(t).alias("origin")], c) for t, c in (("pages", "html"), ("documents", "text"), ("events", "props"), ("conversations", "text"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole.join(F.broadcast(catalogue(spark)), "mime_type", "left_anti").groupBy("origin", "mime_type").agg(F.count("*").alias("n"))


def plain_metadata(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("long").alias("character_count"), d.line_count(t).cast("long").alias("line_count"), d.encoding(t.cast("binary")).alias("encoding"))


def csv_delimiter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", d.delimiter(F.col("text").cast("binary")).alias("delimiter"))


def html_title(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", d.trimmed(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def html_meta(spark, sf):
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, r"(?i)<meta[^>]*\bcharset=\"?([-\w]+)", 1).alias("charset"), F.regexp_extract(h, r"(?i)<html[^>]*\blang=\"?([-\w]+)", 1).alias("language"))


def html_headings(spark, sf):
    return table(spark, sf, "pages").select("page_id", *[F.regexp_count("html", F.lit(rf"(?i)<h{k}[\s>]")).cast("long").alias(f"heading_h{k}_count") for k in range(1, 7)])


def html_metadata_parsed(spark, sf):
    """The parser's own metadata; its SQL is that of the native twins."""
    rows = extract(table(spark, sf, "pages").select("page_id", "html"), "html", what="metadata")
    get = lambda k, kind="text": F.try_element_at("metadata", F.lit(k))[kind]
    return rows.select("page_id", get("charset").alias("charset"), get("language").alias("language"), get("heading_h1_count", "number").alias("heading_h1_count"))


def html_text(spark, sf):
    """Visible text as a count of its characters without white space, and the text itself."""
    rows = extract(table(spark, sf, "pages").select("page_id", "html"), "html", what="text")
    return rows.select("page_id", F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("n_visible"))


def documents_extracted(spark, sf):
    """Every document by its detected type; tables with uneven records are errors."""
    rows = extract(table(spark, sf, "documents").select("doc_id", "text").withColumnRenamed("text", "body"), "body")
    return rows.select("doc_id", "mime_type", F.col("error.kind").alias("error_kind"), F.length("text").cast("long").alias("n_chars"))


def batch_summary_query(spark, sf):
    """Documents as JSON, of which every third is cut short."""
    whole = F.to_json(F.struct("doc_id", "text"))
    rows = table(spark, sf, "documents").select("doc_id", whole.alias("j"))
    rows = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.expr("left(j, length(j) - 1)")).otherwise(F.col("j")).alias("body"))
    return batch_summary(extract(rows, "body"))


def size_guard(spark, sf):
    """Sizes against limits a thousandth of the real ones, so that some are beyond."""
    rows = table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    return rows.select("page_id", "bytes", guards.too_large(F.lit("text/html"), F.col("bytes"), 0.001).alias("too_large"))


def unsafe_paths(spark, sf):
    kind = F.col("p_partkey") % 6
    path = F.when(kind == 0, F.concat(F.lit("../"), "p_name")).when(kind == 1, F.concat(F.lit("/"), "p_name")).when(kind == 2, F.concat(F.lit("C:"), "p_name")).when(kind == 3, F.concat("p_name", F.lit("/../x"))).when(kind == 4, F.concat(F.lit("a..b/"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", path.alias("path")).select("p_partkey", "path", guards.safe_archive_path(F.col("path")).alias("safe"))


def xml_bomb_guard(spark, sf):
    refs = F.repeat(F.lit("&a;"), (F.col("s_suppkey") % 20).cast("int"))
    text = F.concat(F.lit('<!DOCTYPE x [\n<!ENTITY a "x">\n<!ENTITY b "'), refs, F.lit('">\n]><x>&amp;</x>'))
    return table(spark, sf, "supplier").select("s_suppkey", guards.xml_bomb(text).alias("bomb"))


def looks_like_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", d.looks_like_text(F.col("text")).alias("readable"), d.mostly_letters(F.col("text")).alias("letters"))


def css_signs(spark, sf):
    return table(spark, sf, "pages").select("page_id", d.css_signs(d.trimmed(F.col("html"))).alias("signs"), d.looks_like_css(F.col("html")).alias("css"))


def read_chunks(spark, sf):
    rows = chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 1000)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


def sink_detection_text(spark, sf):
    x = d.detect(F.col("html").cast("binary"), archives=False)
    return table(spark, sf, "pages").select("page_id", x.alias("x")).select("page_id", sinks.detection_text(F.col("x")).alias("shown"))


def sink_detection_json(spark, sf):
    x = d.detect(F.col("text").cast("binary"), archives=False)
    return table(spark, sf, "documents").select("doc_id", x.alias("x")).select("doc_id", sinks.detection_json(F.col("x")).alias("shown"))


_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SHADOWED: list[tuple[str, int, str]] = []
for _m, _o, _p in SIGNATURES:
    if not any((o, p) == (_o, _p) for _, o, p in _SHADOWED):
        _SHADOWED.append((_m, _o, _p))
_LINES = "(CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END END)"


_ANY_OF = lambda *xs: "(" + " OR ".join(f"contains(t, '{x}')" for x in xs) + ")"
_SIGNS = f"""(CASE WHEN contains(t, '{{') AND contains(t, '}}') AND contains(t, ':') THEN 1 ELSE 0 END + CASE WHEN {_ANY_OF('@import', '@media', '@charset', '@font-face', '@keyframes', '@supports')} THEN 1 ELSE 0 END
      + CASE WHEN {_ANY_OF('color:', 'background:', 'margin:', 'padding:', 'font-', 'border:', 'width:', 'height:', 'display:', 'position:')} THEN 1 ELSE 0 END + CASE WHEN contains(t, ';') THEN 1 ELSE 0 END)"""


def found_sql(source: str, key: str, text: str) -> str:
    """(key, mime_type, confidence, detected_by) of a text column."""
    magic = " ".join(f"WHEN substr(h, {2 * o + 1}, {len(p)}) = '{p.upper()}' THEN '{m}'" for m, o, p in _SHADOWED)
    signs = _SIGNS
    keys = key + ", " if key else ""
    return f"""SELECT {keys}COALESCE(m, CASE WHEN s = '' THEN 'application/octet-stream' WHEN j THEN 'application/json' WHEN x THEN CASE WHEN contains(t, '<?xml') THEN 'text/xml' WHEN contains(t, '<html') OR contains(t, '<HTML') THEN 'text/html' WHEN contains(t, '<svg') THEN 'image/svg+xml' ELSE 'text/xml' END
       WHEN c THEN 'text/css' WHEN v THEN 'text/csv' ELSE 'text/plain' END) AS mime_type,
     CAST(CASE WHEN m IS NOT NULL THEN 0.95 WHEN s = '' THEN 0.1 WHEN j OR x THEN 0.7 WHEN c THEN 0.6 ELSE 0.7 END AS DOUBLE) AS confidence,
     CASE WHEN m IS NOT NULL THEN 'magic_bytes' WHEN s = '' THEN 'unknown' ELSE 'content_analysis' END AS detected_by
   FROM (SELECT *, CASE {magic} END AS m, (starts_with(t, '{{') AND ends_with(t, '}}')) OR (starts_with(t, '[') AND ends_with(t, ']')) AS j, starts_with(t, '<') AND contains(t, '>') AS x,
      strlen(t) >= 10 AND {signs} >= 2 AS c, {_LINES.format(t='s')} > 1 AND (contains(split_part(s, chr(10), 1), ',') OR contains(split_part(s, chr(10), 1), chr(9))) AS v
   FROM (SELECT {keys}{text} AS s, regexp_replace({text}, '^{_SPACE}|{_SPACE}$', '', 'g') AS t, hex(encode(substr({text}, 1, 300))) AS h FROM {source}))"""


_ALL = " UNION ALL ".join(f"SELECT '{t}' AS origin, mime_type, confidence, detected_by FROM ({found_sql(t, '', c)})" for t, c in (("pages", "html"), ("documents", "text"), ("events", "props"), ("conversations", "text")))
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_EXT = sorted(EXTENSIONS)
_CHARSET = "regexp_extract(html, '(?i)<meta[^>]*\\bcharset=\"?([-\\w]+)', 1)"
_LANG = "regexp_extract(html, '(?i)<html[^>]*\\blang=\"?([-\\w]+)', 1)"
_MARKS = (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|"))
_COUNT = "list_transform(lines, lambda s: length(s) - length(replace(s, '{m}', '')))"

_DELIMITER_SQL = f"""WITH h AS (SELECT doc_id, text, substr(text, 1, 1024) AS cut FROM documents),
      b AS (SELECT doc_id, list_reduce(list_concat([0], list_transform(range(1, length(cut) + 1), lambda i: CAST(i AS BIGINT))), lambda a, i: CASE WHEN strlen(substr(cut, 1, i)) <= 1024 THEN i ELSE a END) AS n, cut FROM h),
      l AS (SELECT doc_id, string_split(regexp_replace(substr(cut, 1, n), '\\n$', ''), chr(10))[1:10] AS lines, strlen(substr(cut, 1, n)) = 1024 OR n = length(cut) AS whole FROM b),
      s AS (SELECT doc_id, whole, {', '.join(f"len(list_filter({_COUNT.format(m=m)}, lambda c: c = ({_COUNT.format(m=m)})[1])) * ({_COUNT.format(m=m)})[1] AS {n}" for n, m in _MARKS)} FROM l)
      SELECT doc_id, CASE WHEN NOT whole OR greatest(comma, semicolon, tab, pipe) = 0 THEN 'comma' {' '.join(f"WHEN {n} = greatest(comma, semicolon, tab, pipe) THEN '{n}'" for n, _ in _MARKS)} END AS delimiter FROM s"""
_DELIMITERS = "CASE delimiter WHEN 'semicolon' THEN ';' WHEN 'tab' THEN chr(9) WHEN 'pipe' THEN '|' ELSE ',' END"
#: A table whose lines haven't one number of fields is an error; other tables show their fields with a comma and a blank between.
_EXTRACTED = """WITH f AS ({found}), c AS ({csv}), l AS (
      SELECT doc_id, text, mime_type, {mark} AS mark, list_filter(string_split(regexp_replace(text, '\\r', '', 'g'), chr(10)), lambda s: s <> '') AS lines FROM documents JOIN f USING (doc_id) JOIN c USING (doc_id)),
      e AS (SELECT *, mime_type = 'text/csv' AND len(list_distinct(list_transform(lines, lambda s: length(s) - length(replace(s, mark, ''))))) > 1 AS uneven FROM l)
      SELECT doc_id, mime_type, CASE WHEN uneven THEN 'ParseError' END AS error_kind,
        CASE WHEN uneven THEN NULL WHEN mime_type = 'text/csv' THEN length(replace(array_to_string(lines, chr(10)), mark, ', ')) ELSE length(text) END AS n_chars FROM e"""

QUERIES = {
    "detect_pages": detect_pages, "detect_documents": detect_documents, "detect_props": detect_props, "detect_conversations": detect_conversations, "detect_summary": detect_summary,
    "detect_magic_table": detect_magic_table, "detect_extension": detect_extension, "detect_with_hint": detect_with_hint, "confidence_context": confidence_context, "encoding_sniff": encoding_sniff,
    "supported_formats": supported_formats, "unsupported_rows": unsupported_rows, "plain_metadata": plain_metadata, "csv_delimiter": csv_delimiter, "html_title": html_title, "html_meta": html_meta,
    "html_headings": html_headings, "html_metadata_parsed": html_metadata_parsed, "html_text": html_text, "documents_extracted": documents_extracted, "batch_summary": batch_summary_query,
    "size_guard": size_guard, "unsafe_paths": unsafe_paths, "xml_bomb_guard": xml_bomb_guard, "looks_like_text": looks_like_text, "css_signs": css_signs, "read_chunks": read_chunks,
    "sink_detection_text": sink_detection_text, "sink_detection_json": sink_detection_json,
}

ORACLE = {
    "detect_pages": found_sql("pages", "page_id", "html"),
    "detect_documents": found_sql("documents", "doc_id", "text"),
    "detect_props": found_sql("events", "event_id", "props"),
    "detect_conversations": found_sql("conversations", "conv_id, turn", "text"),
    "detect_summary": f"SELECT mime_type, detected_by, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM ({_ALL}) GROUP BY mime_type, detected_by",
    "detect_magic_table": f"""WITH p(ord, mime, off, pat) AS (VALUES {_VALUES([(k, m, o, p.upper()) for k, (m, o, p) in enumerate(SIGNATURES)])}),
      d AS (SELECT doc_id, hex(encode(substr(text, 1, 300))) AS h FROM documents), hit AS (SELECT doc_id, min(ord) AS ord FROM d JOIN p ON substr(h, 2 * off + 1, length(pat)) = pat GROUP BY doc_id)
      SELECT d.doc_id, p.mime AS mime_type, hit.ord FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN p ON p.ord = hit.ord""",
    "detect_extension": f"""WITH e(k, ext, mime_type) AS (VALUES {_VALUES([(k, x, EXTENSIONS[x]) for k, x in enumerate(_EXT)])})
      SELECT doc_id, source || '/v1.0/f' || doc_id || '.' || CASE WHEN doc_id % 2 = 0 THEN upper(ext) ELSE ext END AS path, mime_type FROM documents JOIN e ON e.k = doc_id % {len(_EXT)}""",
    "detect_with_hint": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE mime_type END AS mime_type, CASE WHEN doc_id % 2 = 0 THEN 'hint' ELSE detected_by END AS detected_by FROM ({found_sql('documents', 'doc_id', 'text')})",
    "confidence_context": """SELECT doc_id, strlen(text) AS bytes, round(greatest(0.0, least(1.0, CAST(0.7 AS DOUBLE) + CASE WHEN doc_id % 3 = 0 THEN 0.05 ELSE 0 END + CASE WHEN strlen(text) < 10 THEN -0.1 WHEN strlen(text) < 100 THEN -0.05 ELSE 0 END)), 6) AS confidence FROM documents""",
    "encoding_sniff": "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'UTF-16LE' WHEN 2 THEN 'UTF-16BE' ELSE 'UTF-8' END AS encoding, length(text) AS n_chars FROM documents",
    "supported_formats": f"SELECT * FROM (VALUES {_VALUES([(m,) for m in supported()])}) AS v(mime_type)",
    "unsupported_rows": f"SELECT origin, mime_type, count(*) AS n FROM ({_ALL}) WHERE mime_type NOT IN ({', '.join(repr(m) for m in supported())}) GROUP BY origin, mime_type",
    "plain_metadata": f"SELECT doc_id, length(text) AS character_count, CAST({_LINES.format(t='text')} AS BIGINT) AS line_count, 'UTF-8' AS encoding FROM documents",
    "csv_delimiter": _DELIMITER_SQL,
    "html_title": f"SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^{_SPACE}|{_SPACE}$', '', 'g') AS title FROM pages",
    "html_meta": f"SELECT page_id, {_CHARSET} AS charset, {_LANG} AS language FROM pages",
    "html_headings": "SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '(?i)<h{k}[\\s>]')) AS BIGINT) AS heading_h{k}_count" for k in range(1, 7)) + " FROM pages",
    "html_metadata_parsed": f"SELECT page_id, {_CHARSET} AS charset, {_LANG} AS language, CAST(len(regexp_extract_all(html, '(?i)<h1[\\s>]')) AS BIGINT) AS heading_h1_count FROM pages",
    "html_text": """WITH b AS (SELECT page_id, regexp_replace(html, '(?is)^.*?<body[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS t FROM pages),
      v AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&lt;', '<') AS t FROM b)
      SELECT page_id, length(regexp_replace(t, '\\s', '', 'g')) AS n_visible FROM v""",
    "documents_extracted": _EXTRACTED.format(found=found_sql("documents", "doc_id", "text"), csv=_DELIMITER_SQL, mark=_DELIMITERS),
    "batch_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 3 <> 0) AS succeeded, count(*) FILTER (WHERE doc_id % 3 = 0) AS failed FROM documents",
    "size_guard": f"SELECT page_id, strlen(html) AS bytes, strlen(html) > {int(SIZE_LIMITS['text/html'] * 0.001)} AS too_large FROM pages",
    "unsafe_paths": """WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '../' || p_name WHEN 1 THEN '/' || p_name WHEN 2 THEN 'C:' || p_name WHEN 3 THEN p_name || '/../x' WHEN 4 THEN 'a..b/' || p_name ELSE p_name END AS path FROM part)
      SELECT p_partkey, path, p_partkey % 6 >= 4 AS safe FROM p""",
    "xml_bomb_guard": "SELECT s_suppkey, s_suppkey % 20 > 10 AS bomb FROM supplier",
    "looks_like_text": """SELECT doc_id, length(text) > 0 AND len(regexp_extract_all(text, '[\\x20-\\x7E\\t\\n\\r]|[\\p{L}]')) >= length(text) * 0.6 AND regexp_matches(text, '[A-Za-z0-9]{4}') AS readable,
      length(text) >= 3 AND len(regexp_extract_all(text, '[A-Za-z]')) >= length(text) * 0.5 AS letters FROM documents""",
    "css_signs": f"SELECT page_id, CAST({_SIGNS} AS INTEGER) AS signs, strlen(t) >= 10 AND {_SIGNS} >= 2 AS css FROM (SELECT page_id, regexp_replace(html, '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM pages)",
    "read_chunks": "SELECT doc_id, k AS chunk_no, substr(text, k * 1000 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS k FROM documents WHERE length(text) > 0)",
    "sink_detection_text": f"SELECT page_id, 'MIME Type: ' || mime_type || chr(10) || 'Confidence: ' || printf('%.2f', confidence) || chr(10) || 'Detected By: ' || CASE detected_by WHEN 'magic_bytes' THEN 'MagicBytes' WHEN 'content_analysis' THEN 'ContentAnalysis' ELSE 'Unknown' END AS shown FROM ({found_sql('pages', 'page_id', 'html')})",
    "sink_detection_json": f"SELECT doc_id, '{{\"mime_type\":\"' || mime_type || '\",\"confidence\":' || confidence || ',\"detected_by\":\"' || detected_by || '\"}}' AS shown FROM ({found_sql('documents', 'doc_id', 'text')})",
}
