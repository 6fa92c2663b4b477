"""Writers of small files of many formats, for queries and tests: bytes out of keys and names."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400
_START = 1_000_000_000


def made(build: Callable[..., bytes], *columns: Column) -> Column:
    """Bytes that ``build`` makes of each row's values; null where it fails on a null."""

    @F.pandas_udf("binary")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else build(*row) for row in zip(*series)], dtype=object)

    return run(*columns)


def zipped(parts: dict[str, str | bytes], packed: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED if name == "mimetype" else None)
    return out.getvalue()


def archive_zip(keys, names) -> bytes:
    """A file for each name, of the name's own length times its key."""
    return zipped({f"nation/{n}.txt": n * int(k) for k, n in zip(keys, names)})


def archive_tar(keys, names) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for k, n in zip(keys, names):
            info = tarfile.TarInfo(f"nation/{n}.txt")
            info.size, info.mtime = len(n) * int(k), _START + int(k) * _DAY
            t.addfile(info, io.BytesIO((n * int(k)).encode()))
    return out.getvalue()


def _core(title: str, author: str) -> str:
    return f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dcterms:created>2020-01-02T03:04:05Z</dcterms:created><cp:revision>7</cp:revision></cp:coreProperties>'


def _types(kind: str) -> str:
    return f'<?xml version="1.0"?><Types xmlns="x"><Override PartName="/main.xml" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/></Types>'


def docx(keys, names) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(n)}</w:t></w:r></w:p>" for n in names)
    return zipped({"[Content_Types].xml": _types("wordprocessingml.document"), "word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>', "docProps/core.xml": _core(f"{len(names)} nations", names[0])})


def pptx(keys, names) -> bytes:
    """A slide for each name; those of even keys have notes."""
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:sld>'
    parts = {"[Content_Types].xml": _types("presentationml.presentation"), "docProps/core.xml": _core("slides", names[0])}
    for i, (k, n) in enumerate(zip(keys, names), 1):
        parts[f"ppt/slides/slide{i}.xml"] = slide(n)
        if k % 2 == 0:
            parts[f"ppt/notesSlides/notesSlide{i}.xml"] = slide(f"about {n}")
    return zipped(parts)


def xlsx(keys, names) -> bytes:
    shared = "".join(f"<si><t>{escape(n)}</t></si>" for n in names)
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{int(k)}</v></c><c r="B{i}" t="s"><v>{i - 1}</v></c></row>' for i, k in enumerate(keys, 1))
    return zipped({
        "[Content_Types].xml": _types("spreadsheetml.sheet"),
        "xl/workbook.xml": '<workbook xmlns="w" xmlns:r="r"><sheets><sheet name="Nations" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })


def _open(kind: str, body: str) -> bytes:
    spaces = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:draw="d" xmlns:dc="c" xmlns:meta="m"'
    meta = f"<office:document-meta {spaces}><office:meta><dc:title>nations</dc:title><dc:creator>someone</dc:creator></office:meta></office:document-meta>"
    return zipped({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "META-INF/manifest.xml": "<manifest/>", "content.xml": f"<office:document-content {spaces}><office:body>{body}</office:body></office:document-content>", "meta.xml": meta})


def odt(keys, names) -> bytes:
    return _open("text", "<office:text>" + "".join(f"<text:p>{escape(n)}</text:p>" for n in names) + "</office:text>")


def ods(keys, names) -> bytes:
    cell = lambda v: f"<table:table-cell><text:p>{escape(str(v))}</text:p></table:table-cell>"
    return _open("spreadsheet", '<office:spreadsheet><table:table table:name="Nations">' + "".join(f"<table:table-row>{cell(k)}{cell(n)}</table:table-row>" for k, n in zip(keys, names)) + "</table:table></office:spreadsheet>")


def odp(keys, names) -> bytes:
    return _open("presentation", "<office:presentation>" + "".join(f"<draw:page><text:p>{escape(n)}</text:p></draw:page>" for n in names) + "</office:presentation>")


def epub(keys, names) -> bytes:
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(names)))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    package = f'<package xmlns:dc="d"><metadata><dc:title>Nations</dc:title><dc:creator>{escape(names[0])}</dc:creator><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="book/p.opf"/></rootfiles></container>', "book/p.opf": package}
    return zipped(parts | {f"book/c{i}.xhtml": f"<html><head><title>x</title></head><body><p>{escape(n)}</p></body></html>" for i, n in enumerate(names)})


def png(width: int, height: int, texts: list[tuple[str, str, str]]) -> bytes:
    """texts: (tEXt, zTXt or iTXt, keyword, text)."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    for kind, key, text in texts:
        body = {"tEXt": text.encode(), "zTXt": b"\0" + zlib.compress(text.encode()), "iTXt": b"\1\0\0\0" + zlib.compress(text.encode())}[kind]
        out += chunk(kind.encode(), key.encode() + b"\0" + body)
    return out + chunk(b"IEND", b"")


def png_of_pixels(img) -> bytes:
    """A grey image of eight bits; the rows take turns at the five filters."""
    import numpy as np

    rows, above = [], np.zeros(img.shape[1], np.int64)
    for y, row in enumerate(img.astype(np.int64)):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        near = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner]))  # of left, above, corner
        paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], above, corner))
        guess = (0 * row, left, above, (left + above) // 2, paeth)[y % 5]
        rows.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def png_of_part(key, name, brand, kind) -> bytes:
    return png(int(key) % 4096 + 1, int(key) % 100 + 1, [("tEXt", "Title", name), ("zTXt", "Brand", brand), ("iTXt", "Type", kind)])


def jpeg(width, height) -> bytes:
    return b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, int(height), int(width), 3) + b"\1\x11\0\2\x11\0\3\x11\0" + b"\xff\xd9"


def webp(width, height) -> bytes:
    body = b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (int(width) - 1).to_bytes(3, "little") + (int(height) - 1).to_bytes(3, "little")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tiff_gps(key, degrees, minutes, seconds, south) -> bytes:
    """A TIFF directory with a camera's maker, a time and a place."""
    fields: list[tuple[int, int, int, bytes]] = []
    texts = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    ratio = lambda *v: b"".join(struct.pack("<II", int(x), 1) for x in v)

    def directory(at: int, fields: list) -> bytes:
        head, tail = struct.pack("<H", len(fields)), b""
        end = at + 2 + 12 * len(fields) + 4
        for tag, kind, n, body in fields:
            if len(body) <= 4:
                head += struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, kind, n, end + len(tail))
                tail += body + b"\0" * (len(body) % 2)
        return head + struct.pack("<I", 0) + tail

    place = [(1, 2, 2, (b"S" if south else b"N") + b"\0"), (2, 5, 3, ratio(degrees, minutes, seconds)), (3, 2, 2, b"E\0"), (4, 5, 3, ratio(degrees, 0, 0))]
    fields = [(256, 3, 1, struct.pack("<H", 10)), (257, 3, 1, struct.pack("<H", 20)), texts(271, f"Maker {int(key)}"), texts(306, f"2020:01:{int(key) % 28 + 1:02d} 03:04:05")]
    gps = lambda at: [*fields, (34853, 4, 1, struct.pack("<I", at))]
    size = len(directory(8, gps(0)))
    return b"II*\0" + struct.pack("<I", 8) + directory(8, gps(8 + size)) + directory(8 + size, place)


def id3(title, artist, genre, year, track) -> bytes:
    frame = lambda name, text: name + struct.pack(">I", len(text.encode()) + 1) + b"\0\0" + b"\3" + text.encode()
    body = frame(b"TIT2", title) + frame(b"TPE1", artist) + frame(b"TCON", genre) + frame(b"TYER", str(int(year))) + frame(b"TRCK", f"{int(track)}/99")
    size = len(body)
    return b"ID3\3\0\0" + bytes((size >> s) & 127 for s in (21, 14, 7, 0)) + body


def pdf(lines, title, packed=True, version="1.5", pack=None) -> bytes:
    """One page that shows each line, with a cross-reference table. ``pack`` gives the stream and its filter from the page's content."""
    said = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    content = " ".join(f"BT /F1 12 Tf 72 {720 - 20 * k} Td ({said(t)}) Tj ET" for k, t in enumerate(lines)).encode("latin-1", "replace")
    stream, how = (zlib.compress(content), b" /Filter /FlateDecode") if packed else (content, b"")
    stream, how = pack(content) if pack else (stream, how)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(stream), how, stream), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Title (%s) >>" % said(title).encode("latin-1", "replace"),
    ]
    out, places = f"%PDF-{version}\n".encode(), []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R /Info 6 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def pdf_of_pixels(img) -> bytes:
    """A page that shows one grey image and no text."""
    body = zlib.compress(img.tobytes())
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /XObject << /Im1 5 0 R >> >> >>", b"<< /Length 30 >>\nstream\nq 200 0 0 50 72 700 cm /Im1 Do \nendstream",
        b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (img.shape[1], img.shape[0], len(body), body),
    ]
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def ole_file(streams: dict[str, bytes]) -> bytes:
    """A compound file of version 3: a header, one table of sectors, a directory, and each stream in sectors of its own."""
    size, tables = 512, 1
    names = ["Root Entry", *streams]
    listing = -(-len(names) // 4)
    bodies = [body.ljust(4096, b"\0") for body in streams.values()]  # long enough to stand outside the small streams
    fat, starts, at = [0xFFFFFFFD], [], tables + listing
    fat += [k + 2 for k in range(listing - 1)] + [0xFFFFFFFE]
    for body in bodies:
        n = -(-len(body) // size)
        starts.append(at)
        fat += [at + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
        at += n
    if len(fat) > size // 4:
        raise ValueError("too large for one table of sectors")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, tables, tables, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    entries = b""
    for k, name in enumerate(names):
        text = name.encode("utf-16-le") + b"\0\0"
        kind, start, length = (5, 0xFFFFFFFE, 0) if not k else (2, starts[k - 1], len(bodies[k - 1]))
        entries += text.ljust(64, b"\0") + struct.pack("<HBBIII", len(text), kind, 1, 0xFFFFFFFF, k + 1 if 0 < k < len(names) - 1 else 0xFFFFFFFF, 1 if not k and streams else 0xFFFFFFFF) + bytes(36) + struct.pack("<III", start, length, 0)
    free = bytes(66) + bytes(2) + b"\xff" * 12 + bytes(48)
    entries += free * (listing * 4 - len(names))
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff")
    return head + table + entries + b"".join(body.ljust(-(-len(body) // size) * size, b"\0") for body in bodies)


def xls(sheet, rows) -> bytes:
    """A workbook of one sheet: numbers, whole numbers, truths and shared strings; a text in a cell of its own where it begins a row."""
    record = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    text = lambda t, count="<H": struct.pack(count, len(t)) + (b"\0" + t.encode("latin-1") if all(c < "\u0100" for c in t) else b"\1" + t.encode("utf-16-le"))
    shared: list[str] = []
    cells = b""
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            head = struct.pack("<HHH", r, c, 0)
            if isinstance(v, bool):
                cells += record(0x205, head + bytes([v, 0]))
            elif isinstance(v, int):
                cells += record(0x27E, head + struct.pack("<I", v << 2 & 0xFFFFFFFF | 2))
            elif isinstance(v, float):
                cells += record(0x203, head + struct.pack("<d", v))
            elif c == 0:
                cells += record(0x204, head + text(v))
            else:
                if v not in shared:
                    shared.append(v)
                cells += record(0xFD, head + struct.pack("<I", shared.index(v)))
    begin = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    strings = record(0xFC, struct.pack("<II", len(shared), len(shared)) + b"".join(map(text, shared)))
    bound = lambda at: record(0x85, struct.pack("<IBB", at, 0, 0) + text(sheet, "<B"))
    start = len(begin) + len(bound(0)) + len(strings) + 4
    sheet_of = record(0x809, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + cells + record(0x0A)
    return ole_file({"Workbook": begin + bound(start) + strings + record(0x0A) + sheet_of})


def xls_of_part(key, name, brand, size, price) -> bytes:
    return xls("Parts", [["key", "name", "size", "large", "price"], [str(name), str(brand), int(size), bool(int(size) > 25), float(price)], [str(int(key)), str(name), -int(size), False, float(int(price))]])


def lzw_packed(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    table = {bytes([k]): k for k in range(256)}
    out, held, bits, width, word = bytearray(), 0, 0, 9, b""

    def put(code: int):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for k in range(len(data)):
        c = data[k : k + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = len(table) + 2
        if len(table) + 2 in (512, 1024, 2048):
            width += 1
        if len(table) + 2 == 4094:
            put(256)
            table, width = {bytes([k]): k for k in range(256)}, 9
        word = c
    if word:
        put(table[word])
        if len(table) + 3 in (512, 1024, 2048):  # a reader adds an entry for this code as well
            width += 1
    put(257)
    return bytes(out + bytes([held << (8 - bits) & 255] if bits else []))


def pdf_packed(key, name, kind) -> bytes:
    """The text stream packed by LZW, as base-85 digits, or both, in turn."""
    import base64

    digits = lambda b: base64.a85encode(b) + b"~>"
    packs = (lambda c: (lzw_packed(c), b" /Filter /LZWDecode"), lambda c: (digits(c), b" /Filter /ASCII85Decode"), lambda c: (digits(lzw_packed(c)), b" /Filter [/ASCII85Decode /LZWDecode]"))
    return pdf([name, kind], name, pack=packs[int(key) % 3])


def pdf_of_part(key, name, kind) -> bytes:
    """Of every third only the stream is left, which must be found by a scan."""
    data = pdf([name, kind], name, packed=key % 2 == 0)
    return data[:9] + data[data.index(b"4 0 obj") : data.index(b"5 0 obj")] if key % 3 == 0 else data
