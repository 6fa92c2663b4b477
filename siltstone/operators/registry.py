"""Which parser reads which media type. Types are compared exactly; a later registration replaces an earlier one."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import formats as f
from .parsers import archives, legacy, media, office, pdf, text

Parser = Callable[[bytes], tuple[str | None, dict]]

_parsers: dict[str, Parser] = {}


def register(mime: str | list[str], parser: Parser) -> None:
    """A parser of one's own is a function of bytes that returns (text or None, metadata) and raises on failure."""
    for m in [mime] if isinstance(mime, str) else mime:
        _parsers[m] = parser


def parser_of(mime: str | None) -> Parser | None:
    return _parsers.get(mime)


def supported() -> list[str]:
    return sorted(_parsers)


for _mime, _parser in {
    "text/plain": text.plain, "application/json": text.json, "text/csv": text.csv, "text/xml": text.xml, "text/html": text.html, "text/css": text.css, "application/rtf": text.rtf,
    "text/markdown": text.markdown, "application/pdf": pdf.pdf, f.DOCX: office.docx, f.ODT: office.odt, f.XLSX: office.xlsx, f.PPTX: office.pptx, f.ODS: office.ods, f.ODP: office.odp,
    f.XLS: legacy.xls, f.DOC: legacy.doc, f.PPT: legacy.ppt, f.EPUB: office.epub, "image/jpeg": media.jpeg, "image/png": media.png, "image/tiff": media.tiff, "image/webp": media.webp,
    "image/svg+xml": media.svg, "audio/mpeg": media.mp3, "application/zip": archives.zip_, "application/x-tar": archives.tar,
}.items():
    register([_mime, *(a for a, m in f.ALIASES.items() if m == _mime)], _parser)
