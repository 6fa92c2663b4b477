"""Table functions: rows out of archives, sheets, slides, chunks and streams.

Bytes that can't be read, or break off, give the rows before that and one whose
``error`` says so; all its other columns but a number are null.
"""

from __future__ import annotations

from pyspark.sql.functions import udtf

from .parsers import archives, media, office, pdf


def _rows(read, data, *more):
    """(found, None) for all that a reader finds; if it breaks, what it has found so far and (None, error)."""
    if data is None:
        return
    try:
        for found in read(bytes(data), *more):
            yield found, None
    except Exception as e:
        yield None, f"{type(e).__name__}: {e}"


@udtf(returnType="ord int, path string, size bigint, compressed_size bigint, safe boolean, error string")
class ZipEntries:
    def eval(self, data):
        for k, (x, error) in enumerate(_rows(archives.zip_entries, data)):
            yield (k, *x, archives.safe_path(x[0]), None) if x else (k, None, None, None, None, error)


@udtf(returnType="ord int, path string, size bigint, modified string, safe boolean, error string")
class TarEntries:
    def eval(self, data):
        for k, (x, error) in enumerate(_rows(archives.tar_entries, data)):
            yield (k, *x, archives.safe_path(x[0]), None) if x else (k, None, None, None, None, error)


@udtf(returnType="sheet string, row int, cells array<string>, error string")
class SheetRows:
    def eval(self, data):
        for x, error in _rows(office.xlsx_sheets, data):
            if error:
                yield None, None, None, error
            else:
                for k, r in enumerate(x[1]):
                    yield x[0], k, r, None


@udtf(returnType="slide int, text string, notes string, error string")
class Slides:
    def eval(self, data):
        for k, (x, error) in enumerate(_rows(office.pptx_slides, data), 1):
            yield (k, *x, None) if x else (k, None, None, error)


@udtf(returnType="ord int, kind string, keyword string, text string, error string")
class PngTexts:
    def eval(self, data):
        for k, (x, error) in enumerate(_rows(media.png_texts, data)):
            yield (k, *x, None) if x else (k, None, None, None, error)


@udtf(returnType="ord int, length int, text string, error string")
class PdfStreams:
    def eval(self, data):
        for k, (s, error) in enumerate(_rows(pdf.streams, data)):
            if error:
                yield k, None, None, error
                continue
            got = next((g for g in (f(s) for f in (pdf.inflate, pdf.lzw, pdf.ascii85, bytes)) if g and (b"Tj" in g or b"TJ" in g)), None)
            yield k, len(s), pdf.content_text(got) if got else None, None


@udtf(returnType="ord int, image binary, error string")
class PdfImages:
    def eval(self, data):
        for k, (image, error) in enumerate(_rows(lambda b: pdf.Document(b).images(), data)):
            yield k, image, error


FUNCTIONS = {"zip_entries": ZipEntries, "tar_entries": TarEntries, "sheet_rows": SheetRows, "slides": Slides, "png_texts": PngTexts, "pdf_streams": PdfStreams, "pdf_images": PdfImages}


def register(spark) -> None:
    """For SQL: SELECT ... FROM files, LATERAL zip_entries(content)."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
