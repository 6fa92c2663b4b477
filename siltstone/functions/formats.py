"""Media types by leading bytes and by file extension, and their size limits, as data."""

from __future__ import annotations

_OOXML = "application/vnd.openxmlformats-officedocument."
_ODF = "application/vnd.oasis.opendocument."
DOCX, XLSX, PPTX = (_OOXML + x for x in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation"))
ODT, ODS, ODP = (_ODF + x for x in ("text", "spreadsheet", "presentation"))
EPUB, DOC, XLS, PPT = "application/epub+zip", "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"
ZIP_HEAD, OLE_HEAD = bytes.fromhex("504b0304"), bytes.fromhex("d0cf11e0a1b11ae1")
UNKNOWN = "application/octet-stream"

#: (type, offset, hex) in the order in which they are tried. A later entry with the same bytes is never reached; they
#: stay, as the order of the whole list is what is specified.
SIGNATURES = [
    ("application/pdf", 0, "255044462d"), (DOCX, 0, "504b0304"), (ODT, 0, "504b0304"), ("application/rtf", 0, "7b5c727466"),
    ("image/jpeg", 0, "ffd8ff"), ("image/png", 0, "89504e470d0a1a0a"), ("image/gif", 0, "474946383761"), ("image/gif", 0, "474946383961"),
    ("image/tiff", 0, "49492a00"), ("image/tiff", 0, "4d4d002a"), ("image/bmp", 0, "424d"), ("image/webp", 8, "57454250"),
    ("image/x-icon", 0, "00000100"), ("image/svg+xml", 0, "3c737667"), ("application/zip", 0, "504b0304"), ("application/zip", 0, "504b0506"),
    ("application/zip", 0, "504b0708"), ("application/x-tar", 257, "7573746172"), ("application/gzip", 0, "1f8b"), ("application/x-bzip2", 0, "425a68"),
    ("application/x-7z-compressed", 0, "377abcaf271c"), ("application/x-rar-compressed", 0, "526172211a07"), ("application/x-xz", 0, "fd377a585a00"),
    ("text/html", 0, "3c21444f43545950452068746d6c"), ("text/html", 0, "3c68746d6c"), ("text/html", 0, "3c48544d4c"), ("text/xml", 0, "3c3f786d6c"),
    ("application/json", 0, "7b"), ("application/json", 0, "5b"), ("audio/mpeg", 0, "fffb"), ("audio/mpeg", 0, "fff3"), ("audio/mpeg", 0, "fff2"),
    ("audio/mpeg", 0, "494433"), ("audio/wav", 0, "52494646"), ("audio/x-flac", 0, "664c6143"), ("audio/ogg", 0, "4f676753"), ("audio/x-m4a", 4, "66747970"),
    ("video/mp4", 4, "66747970"), ("video/x-msvideo", 0, "52494646"), ("video/x-matroska", 0, "1a45dfa3"), ("video/webm", 0, "1a45dfa3"),
    ("video/quicktime", 4, "6d6f6f76"), ("video/quicktime", 4, "6d646174"), ("application/x-executable", 0, "7f454c46"),
    ("application/x-mach-binary", 0, "feedface"), ("application/x-mach-binary", 0, "feedfacf"), ("application/x-msdownload", 0, "4d5a"),
    ("font/ttf", 0, "00010000"), ("font/otf", 0, "4f54544f"), ("font/woff", 0, "774f4646"), ("font/woff2", 0, "774f4632"),
    ("application/x-sqlite3", 0, b"SQLite format 3\0".hex()), (XLSX, 0, "504b0304"), (PPTX, 0, "504b0304"), (ODS, 0, "504b0304"), (ODP, 0, "504b0304"),
]

EXTENSIONS = {
    "pdf": "application/pdf", "doc": DOC, "docx": DOCX, "odt": ODT, "rtf": "application/rtf", "xls": XLS, "xlsx": XLSX, "ods": ODS, "ppt": PPT, "pptx": PPTX, "odp": ODP,
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp",
    "svg": "image/svg+xml", "ico": "image/x-icon", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip", "bz2": "application/x-bzip2",
    "7z": "application/x-7z-compressed", "rar": "application/x-rar-compressed", "xz": "application/x-xz", "txt": "text/plain", "csv": "text/csv", "json": "application/json",
    "xml": "text/xml", "html": "text/html", "htm": "text/html", "css": "text/css", "md": "text/markdown", "markdown": "text/markdown", "epub": EPUB, "mp3": "audio/mpeg",
    "wav": "audio/wav", "flac": "audio/x-flac", "ogg": "audio/ogg", "m4a": "audio/x-m4a", "mp4": "video/mp4", "avi": "video/x-msvideo", "mkv": "video/x-matroska",
    "webm": "video/webm", "mov": "video/quicktime",
}

CONFIDENCE = {"magic_bytes": 0.95, "content_analysis": 0.7, "extension": 0.4, "unknown": 0.1}

MIB = 1 << 20
SIZE_LIMITS = {"text/html": 10 * MIB, "text/css": 5 * MIB, "application/rtf": 20 * MIB} | dict.fromkeys((XLSX, PPTX, ODS, ODP), 100 * MIB) | dict.fromkeys((XLS, DOC, PPT), 50 * MIB)
#: Names under which a format is registered besides its own.
ALIASES = {
    "text/json": "application/json", "text/tab-separated-values": "text/csv", "application/xml": "text/xml", "text/x-markdown": "text/markdown", "application/docx": DOCX,
    "application/odt": ODT, "application/xlsx": XLSX, "application/pptx": PPTX, "application/ods": ODS, "application/odp": ODP, "application/xls": XLS, "application/doc": DOC,
    "application/ppt": PPT, "application/epub": EPUB, "image/jpg": "image/jpeg", "image/tif": "image/tiff", "application/x-zip-compressed": "application/zip",
    "application/tar": "application/x-tar", "audio/mp3": "audio/mpeg",
}
