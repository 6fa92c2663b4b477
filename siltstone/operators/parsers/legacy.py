"""Parsers of binary office formats in OLE2 compound files."""

from __future__ import annotations

import re
import struct

from .base import Corrupted, Failure, Parsed, check_size
from .office import grid, number, serial_date, sheets_parsed
from ...functions.formats import DOC, OLE_HEAD, PPT, XLS

_RUN = re.compile(rb"[\x20-\x7e\n\r\t]{3,}")


def likely(text: str, slides: bool = False) -> bool:
    if len(text) < 3 or slides and "Microsoft" in text and len(text) < 20:
        return False
    return sum(c.isalpha() for c in text) / len(text) >= 0.5


def c_string(data: bytes) -> str | None:
    """Printable characters up to a zero byte or the first other one behind them."""
    m = re.match(rb"[^\x00\x20-\x7e]*([\x20-\x7e]{2,})", data[:100])
    return m[1].decode() if m else None


def ole_property(data: bytes, name: bytes, slides: bool = False) -> str | None:
    """First plausible string within a hundred bytes of a property's name."""
    for m in re.finditer(re.escape(name), data[: max(0, len(data) - 100)]):
        for k in range(m.end(), min(m.end() + 100, len(data))):
            value = c_string(data[k : k + 100])
            if value and likely(value, slides):
                return value
    return None


def _ole(data: bytes, mime: str) -> None:
    check_size(data, mime)
    if not data.startswith(OLE_HEAD):
        raise Corrupted("no compound-file header")


def _named(data: bytes, slides: bool = False) -> dict:
    found = {key: ole_property(data, name, slides) for key, name in (("title", b"Title"), ("author", b"Author"), ("subject", b"Subject"))}
    return {k: v for k, v in found.items() if v and len(v) < 200}


def doc(data: bytes) -> Parsed:
    _ole(data, DOC)
    text = " ".join(" ".join(t for m in _RUN.finditer(data) if likely(t := m[0].decode())).split())
    if not text:
        raise Failure("no text can be read from the document")
    return text, {"parser_note": "text by scanning for readable runs; formatting and field codes are not interpreted"} | _named(data)


def ppt(data: bytes) -> Parsed:
    _ole(data, PPT)
    text, slide, marked = "", 0, False
    for m in _RUN.finditer(data):
        t = m[0].decode()
        if not likely(t, True):
            continue
        if data[m.end() : m.end() + 1] == b"\0":  # titles are sought among strings that end with a zero byte
            if not marked and len(text) > 100 and 10 < len(t) < 100 and t[0].isupper() and "  " not in t:
                slide += 1
                text += f"\n\n--- Slide {slide} ---\n"
                marked = True
            else:
                marked = False
        text += t + " "
    text = " ".join(text.split())
    if not text:
        raise Failure("no text can be read from the presentation")
    meta: dict = {"parser_note": "text by scanning for readable runs; slide structure is estimated"}
    marks = sum(1 for m in re.finditer(rb"(?=\x0f\x00)", data[: max(0, len(data) - 3)]))
    if marks:
        meta["slide_count"] = min(max(marks // 10, 1), 1000)
    return text, meta | _named(data, True)


def ole_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name. Chains that turn back or leave the file end there."""
    if len(data) < 512:
        raise Corrupted("compound file without a whole header")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    if shift not in (9, 12) or small_shift > shift:
        raise Corrupted("compound file with an unknown sector size")
    size, small = 1 << shift, 1 << small_shift
    dir_at, _, cutoff, mini_at, mini_n, dif_at, dif_n = struct.unpack_from("<IIIIIII", data, 48)
    fats = list(struct.unpack_from("<109I", data, 76))
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    seen: set[int] = set()
    while dif_at < 0xFFFFFFFA and dif_at not in seen:
        seen.add(dif_at)
        s = sector(dif_at)
        if len(s) < size:
            break
        *more, dif_at = struct.unpack(f"<{size // 4}I", s)
        fats += more
    fat: list[int] = []
    for k in fats:
        if k < 0xFFFFFFFA and len(s := sector(k)) == size:
            fat += struct.unpack(f"<{size // 4}I", s)

    def chain(k: int, table: list[int], part) -> bytes:
        out, been = [], set()
        while k < len(table) and k not in been:
            been.add(k)
            out.append(part(k))
            k = table[k]
        return b"".join(out)

    listing = chain(dir_at, fat, sector)
    raw = chain(mini_at, fat, sector)
    mini = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    entries = [listing[k : k + 128] for k in range(0, len(listing) - 127, 128)]
    if not entries:
        raise Corrupted("compound file without a directory")
    root = chain(struct.unpack_from("<I", entries[0], 116)[0], fat, sector)
    streams = {}
    for e in entries:
        n = struct.unpack_from("<H", e, 64)[0]
        if e[66] != 2 or n < 2:
            continue
        name = e[: n - 2].decode("utf-16-le", "replace")
        at, length = struct.unpack_from("<II", e, 116)
        body = chain(at, mini, lambda k: root[k * small : (k + 1) * small]) if length < cutoff else chain(at, fat, sector)
        streams[name] = body[:length]
    return streams


def _unicode(data: bytes, at: int, wide_count: bool = True) -> tuple[str, int]:
    """A BIFF8 string and the place behind it."""
    n = struct.unpack_from("<H", data, at)[0] if wide_count else data[at]
    at += 2 if wide_count else 1
    flags = data[at]
    at += 1
    runs = ext = 0
    if flags & 8:
        runs = struct.unpack_from("<H", data, at)[0]
        at += 2
    if flags & 4:
        ext = struct.unpack_from("<I", data, at)[0]
        at += 4
    size = n * (2 if flags & 1 else 1)
    text = data[at : at + size].decode("utf-16-le" if flags & 1 else "latin-1", "replace")
    return text, at + size + 4 * runs + ext


class _Continued:
    """Strings of a shared table that may break off between records, where a new flag byte tells the width of the rest."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def need(self):
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        if self.k >= len(self.parts):
            raise IndexError

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            self.need()
            piece = self.parts[self.k][self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            out += piece
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        ext = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        wide = flags & 1
        while n:
            if self.at >= len(self.parts[self.k]):
                self.need()
                wide = self.take(1)[0] & 1
            step = min(n, (len(self.parts[self.k]) - self.at) // (2 if wide else 1))
            if not step:
                break
            out.append(self.take(step * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= step
        self.take(4 * runs + ext)
        return "".join(out)


def _rk(v: int) -> float:
    x = struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0] if not v & 2 else float((v >> 2) - (1 << 30 if v & 0x80000000 else 0))
    return x / 100 if v & 1 else x


_ERRORS = {0: "Null", 7: "Div0", 15: "Value", 23: "Ref", 29: "Name", 36: "Num", 42: "NA"}


def xls_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    streams = ole_streams(data)
    book = streams.get("Workbook") or streams.get("Book")
    if book is None:
        raise Corrupted("no workbook stream")
    records, at = [], 0
    end = min(len(book) - 3, len(book.rstrip(b"\0")))  # zeros that fill the last sectors would be read as empty records, four bytes each
    while at < end:
        kind, n = struct.unpack_from("<HH", book, at)
        records.append((at, kind, book[at + 4 : at + 4 + n]))
        at += 4 + n
    bounds, shared, formats, xfs, old = [], [], {}, [], False
    for k, (_, kind, body) in enumerate(records):
        if kind == 0x2F:
            raise Failure("the workbook is encrypted; it needs a password")
        if kind == 0x85 and len(body) > 8:
            bounds.append((struct.unpack_from("<I", body)[0], body[5], _unicode(body, 6, False)[0]))
        elif kind == 0xFC and len(body) >= 8:
            parts = [body[8:]]
            for _, more, rest in records[k + 1 :]:
                if more != 0x3C:
                    break
                parts.append(rest)
            reader = _Continued(parts)
            try:
                for _ in range(struct.unpack_from("<I", body, 4)[0]):
                    shared.append(reader.string())
            except (IndexError, struct.error):
                pass
        elif kind == 0x41E and len(body) > 5:
            code = re.sub(r"\"[^\"]*\"|\\.|\[[^\]]*\]", "", _unicode(body, 2)[0])
            formats[struct.unpack_from("<H", body)[0]] = bool(re.search("[dmyhs]", code, re.I)) and "general" not in code.lower()
        elif kind == 0xE0 and len(body) >= 4:
            xfs.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x22 and len(body) >= 2:
            old = body[0] == 1
    from .office import _DATE_CODES

    def shown(x: float, xf: int) -> str:
        code = xfs[xf] if xf < len(xfs) else 0
        return serial_date(repr(x), old) if code in _DATE_CODES or formats.get(code) else number(repr(x))

    out = []
    for start, kind_of_sheet, name in bounds:
        if kind_of_sheet != 0:
            continue
        cells: dict[tuple[int, int], str] = {}
        depth, waiting = 0, None
        for place, kind, b in records:
            if place < start:
                continue
            try:
                if kind == 0x809:
                    depth += 1
                elif kind == 0x0A:
                    depth -= 1
                    if depth <= 0:
                        break
                elif kind == 0xFD:
                    r, c, _, i = struct.unpack_from("<HHHI", b)
                    cells[r, c] = shared[i] if i < len(shared) else ""
                elif kind == 0x203:
                    r, c, xf, x = struct.unpack_from("<HHHd", b)
                    cells[r, c] = shown(x, xf)
                elif kind == 0x27E:
                    r, c, xf, v = struct.unpack_from("<HHHI", b)
                    cells[r, c] = shown(_rk(v), xf)
                elif kind == 0xBD:
                    r, c = struct.unpack_from("<HH", b)
                    for k in range((len(b) - 6) // 6):
                        xf, v = struct.unpack_from("<HI", b, 4 + 6 * k)
                        cells[r, c + k] = shown(_rk(v), xf)
                elif kind == 0x205:
                    r, c, _, v, is_error = struct.unpack_from("<HHHBB", b)
                    cells[r, c] = f"#ERROR: {_ERRORS.get(v, v)}" if is_error else ("true" if v else "false")
                elif kind == 0x204:
                    r, c, _ = struct.unpack_from("<HHH", b)
                    cells[r, c] = _unicode(b, 6)[0]
                elif kind == 0x06:
                    r, c, xf = struct.unpack_from("<HHH", b)
                    if b[12:14] != b"\xff\xff":
                        cells[r, c] = shown(struct.unpack_from("<d", b, 6)[0], xf)
                    elif b[6] == 0:
                        waiting = (r, c)
                    elif b[6] == 1:
                        cells[r, c] = "true" if b[8] else "false"
                    elif b[6] == 2:
                        cells[r, c] = f"#ERROR: {_ERRORS.get(b[8], b[8])}"
                elif kind == 0x207 and waiting:
                    cells[waiting], waiting = _unicode(b, 0)[0], None
            except (struct.error, IndexError):
                continue
        out.append((name, grid(cells)))
    return out


def xls(data: bytes) -> Parsed:
    check_size(data, XLS)
    if len(data) < 1024:
        raise Corrupted("too small for a workbook")
    if not data.startswith(OLE_HEAD):
        raise Corrupted("no compound-file header")
    return sheets_parsed(xls_sheets(data))
