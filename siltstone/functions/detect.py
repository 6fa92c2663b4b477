"""Media-type detection as column expressions.

Everything but the look into a ZIP container's directory is native, so Catalyst
prunes what isn't asked for and the chain stays inside generated code. A Python
function sees only rows that begin like a ZIP; all others hand it null.
"""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formats import CONFIDENCE, DOC, DOCX, EPUB, EXTENSIONS, OLE_HEAD, PPT, PPTX, SIGNATURES, UNKNOWN, XLS, XLSX, ZIP_HEAD

#: Unicode white space; trim() by itself takes blanks only.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HEAD = 8192


def _bytes(data: bytes) -> Column:
    return F.lit(bytearray(data))


def trimmed(text: Column) -> Column:
    """Looks at the ends alone, so it costs nothing on long texts."""
    return F.btrim(text, F.lit(SPACES))


def method(mime: Column, by: str, confidence: float | None = None) -> Column:
    """A detection, null where ``mime`` is."""
    found = F.struct(mime.alias("mime_type"), F.lit(CONFIDENCE[by] if confidence is None else confidence).cast("float").alias("confidence"), F.lit(by).alias("detected_by"))
    return F.when(mime.isNotNull(), found)


def at(data: Column, offset: int, pattern: bytes) -> Column:
    """Whether bytes stand at an offset; false for data that end before."""
    return F.substring(data, offset + 1, len(pattern)) == _bytes(pattern)


def masked_at(data: Column, offset: int, pattern: bytes, mask: bytes) -> Column:
    """As at(), comparing only the bits of a mask."""
    piece = F.hex(F.substring(data, offset + 1, len(pattern)))
    same = [F.conv(F.substring(piece, 2 * k + 1, 2), 16, 10).cast("int").bitwiseAND(m) == (p & m) for k, (p, m) in enumerate(zip(pattern, mask))]
    return reduce(lambda a, b: a & b, same, F.length(piece) == 2 * len(pattern))


def by_magic(data: Column) -> Column:
    """Type of the first signature that fits; those that an earlier one hides are left out."""
    seen: set[tuple[int, str]] = set()
    chain = None
    for mime, offset, pattern in SIGNATURES:
        if (offset, pattern) in seen:
            continue
        seen.add((offset, pattern))
        test = at(data, offset, bytes.fromhex(pattern))
        chain = F.when(test, mime) if chain is None else chain.when(test, mime)
    return chain


def ole_stream(data: Column, name: str) -> Column:
    """Whether a stream name occurs, as ASCII or UTF-16LE."""
    return F.contains(data, _bytes(name.encode())) | F.contains(data, _bytes(name.encode("utf-16-le")))


def by_ole2(data: Column) -> Column:
    found = F.when(ole_stream(data, "WordDocument") | ole_stream(data, "Word"), DOC).when(ole_stream(data, "Workbook") | ole_stream(data, "Book"), XLS)
    found = found.when(ole_stream(data, "PowerPoint Document") | ole_stream(data, "Current User"), PPT)
    return F.when(at(data, 0, OLE_HEAD) & (F.octet_length(data) >= 512), found)


def zip_subtype(data: bytes | None) -> str | None:
    """Type that a ZIP container's own members declare."""
    if not data or not data.startswith(ZIP_HEAD):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if "mimetype" in names:
                said = z.read("mimetype")[:256].decode("utf-8", "replace").strip()
                if said.startswith("application/vnd.oasis.opendocument.") or said == EPUB:
                    return said
            if "[Content_Types].xml" in names and z.getinfo("[Content_Types].xml").file_size <= 8 << 20:
                said = z.read("[Content_Types].xml").decode("utf-8", "replace")
                return next((m for m in (XLSX, PPTX, DOCX) if m in said), None)
    except Exception:
        return None
    return None


def by_zip(data: Column) -> Column:
    @F.pandas_udf("string")
    def types(data: pd.Series) -> pd.Series:
        return data.map(zip_subtype, na_action="ignore").astype(object)

    return types(F.when(at(data, 0, ZIP_HEAD), data))


def css_signs(text: Column) -> Column:
    """How many of four signs of a style sheet a text has; white space around it makes no difference."""
    has = lambda *xs: reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in xs)).cast("int")
    braces = (F.contains(text, F.lit("{")) & F.contains(text, F.lit("}")) & F.contains(text, F.lit(":"))).cast("int")
    rules = has("@import", "@media", "@charset", "@font-face", "@keyframes", "@supports")
    names = has("color:", "background:", "margin:", "padding:", "font-", "border:", "width:", "height:", "display:", "position:")
    return braces + rules + names + has(";")


def looks_like_css(text: Column) -> Column:
    return (F.octet_length(trimmed(text)) >= 10) & (css_signs(text) >= 2)


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "")


def line_count(text: Column) -> Column:
    """Lines of a text: a last line feed begins none, an empty text has none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def by_content_text(text: Column) -> Column:
    """Detection by the shape of a text; null for an empty one."""
    t = trimmed(text)
    inside = lambda a, b: F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b))
    holds = lambda x: F.contains(text, F.lit(x))  # noqa: E731  no sign has white space, so the untrimmed text does
    tag = F.startswith(t, F.lit("<")) & holds(">")
    markup = F.when(holds("<?xml"), "text/xml").when(holds("<html") | holds("<HTML"), "text/html").when(holds("<svg"), "image/svg+xml").otherwise("text/xml")
    line = first_line(text)
    table = (line_count(text) > 1) & (F.contains(line, F.lit(",")) | F.contains(line, F.lit("\t")))
    json = inside("{", "}") | inside("[", "]")
    shape = lambda mime, c=None: method(F.lit(mime) if isinstance(mime, str) else mime, "content_analysis", c)
    found = F.when(json, shape("application/json")).when(tag, shape(markup)).when(looks_like_css(text), shape("text/css", 0.6))
    return F.when(text != "", found.when(table, shape("text/csv")).otherwise(shape("text/plain")))


def by_content(data: Column) -> Column:
    """As by_content_text() for bytes; null for bytes that aren't UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), by_content_text(data.cast("string")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def by_extension(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, extension(path))


def detect(data: Column, path: Column | None = None, head_only: bool = False, archives: bool = True) -> Column:
    """struct<mime_type, confidence, detected_by> of bytes, null for null bytes.

    Containers first, then signatures, then the shape of the text, then the
    extension if a path is given. With ``head_only`` signatures and shape see the
    first 8 KiB, as a reader of files would; a code point that the cut splits is
    left off. ``archives`` false leaves out the look into ZIP containers, and with
    it all Python; a ZIP is then what its signature says.
    """
    head = data
    if head_only:
        head = F.substring(data, 1, HEAD)
        whole = F.octet_length(data) <= HEAD
        cut = F.regexp_extract(F.hex(head), r"^((?:..)*?)(?:(?:[CDEF].)(?:[89AB].){0,2})?$", 1)
        split = (~whole) & ~F.is_valid_utf8(head.cast("string"))
        text = F.when(split, F.unhex(cut)).otherwise(head)
    else:
        text = head
    steps = []
    if archives:
        kind = by_zip(data)
        plain = at(data, 0, ZIP_HEAD) & kind.isNull()
        steps += [method(kind, "magic_bytes"), F.when(plain, method(F.lit("application/zip"), "magic_bytes"))]
    steps += [method(by_ole2(data), "magic_bytes", 0.9), method(by_magic(head), "magic_bytes"), by_content(text)]
    if path is not None:
        steps.append(method(by_extension(path), "extension"))
    steps.append(method(F.lit(UNKNOWN), "unknown"))
    return F.when(data.isNotNull(), F.coalesce(*steps))


def detect_with_hint(data: Column, hint: Column, archives: bool = True) -> Column:
    """A hint, where there is one, stands without any look at the bytes."""
    given = F.struct(hint.alias("mime_type"), F.lit(1.0).cast("float").alias("confidence"), F.lit("hint").alias("detected_by"))
    return F.when(hint.isNotNull(), given).otherwise(detect(data, archives=archives))


def confidence_in_context(base: Column, several: Column, size: Column) -> Column:
    """A confidence raised by agreeing signs and lowered for little data, within 0..1."""
    value = base + F.when(several, 0.05).otherwise(0.0) + F.when(size < 10, -0.1).when(size < 100, -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def detect_by_join(rows: DataFrame, data: str) -> DataFrame:
    """Signatures as a table: the lowest ordinal among those that fit a row (key columns are kept). Same result as by_magic().

    The list is a literal of a few dozen rows inside each row's own filter, so no
    join is needed and nothing is shuffled.
    """
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("mime"), F.lit(o).alias("offset"), F.lit(bytearray.fromhex(p)).alias("pattern")) for k, (m, o, p) in enumerate(SIGNATURES)])
    fits = F.filter(listed, lambda s: F.substring(F.col(data), s["offset"] + 1, F.octet_length(s["pattern"])) == s["pattern"])
    return rows.withColumn("magic", F.array_min(fits))


def encoding(data: Column) -> Column:
    """Name of a text's encoding, null if it is none of those that are known."""
    return F.when(at(data, 0, b"\xff\xfe"), "UTF-16LE").when(at(data, 0, b"\xfe\xff"), "UTF-16BE").when(at(data, 0, b"\xef\xbb\xbf") | F.is_valid_utf8(data.cast("string")), "UTF-8")


def decoded(data: Column) -> Column:
    """Text of bytes, without a byte-order mark; null if they aren't valid."""
    whole = lambda start: F.substring(data, start, 2147483647)
    wide = lambda name: F.decode(F.substring(data, F.lit(3), F.floor((F.octet_length(data) - 2) / 2).cast("int") * 2), name)
    plain = F.when(at(data, 0, b"\xef\xbb\xbf"), whole(4)).otherwise(data)
    return F.when(at(data, 0, b"\xff\xfe"), wide("UTF-16LE")).when(at(data, 0, b"\xfe\xff"), wide("UTF-16BE")).when(F.is_valid_utf8(plain.cast("string")), plain.cast("string"))


def delimiter(data: Column) -> Column:
    """Delimiter of a table's text: the one whose count in the first ten lines agrees most with that of the first line, weighed by it; a comma if none occurs."""
    head = F.substring(data, 1, 1024)
    lines = F.slice(F.split(F.regexp_replace(head.cast("string"), r"\n$", ""), "\n"), 1, 10)
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  so that a value used often is made once
    marks = ((",", "comma"), (";", "semicolon"), ("\t", "tab"), ("|", "pipe"))

    def score(lines: Column, mark: str) -> Column:
        counts = F.transform(lines, lambda s: F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit(""))))
        return once(counts, lambda c: F.size(F.filter(c, lambda n: n == F.element_at(c, 1))) * F.element_at(c, 1))

    best = once(lines, lambda ls: F.array_max(F.array(*[F.struct(score(ls, m).alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("name")) for k, (m, n) in enumerate(marks)])))
    named = once(best, lambda x: F.when(x["score"] > 0, x["name"]))
    return F.coalesce(F.when(F.is_valid_utf8(head.cast("string")), named), F.lit("comma"))


def looks_like_text(text: Column) -> Column:
    """Whether a text is plausibly readable: six tenths printable, and four ASCII letters or digits in a row."""
    shown = F.regexp_count(text, F.lit(r"[\x20-\x7E\t\n\r]|[^\x00-\x7F&&\P{L}]"))
    return (F.length(text) > 0) & (shown >= F.length(text) * 0.6) & text.rlike("[A-Za-z0-9]{4}")


def mostly_letters(text: Column) -> Column:
    return (F.length(text) >= 3) & (F.regexp_count(text, F.lit("[A-Za-z]")) >= F.length(text) * 0.5)
