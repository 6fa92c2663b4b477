"""Parsers of images and audio tags. Only headers are read: no pixel is decoded."""

from __future__ import annotations

import datetime
import re
import struct
import zlib

from .base import Corrupted, Failure, Parsed, local, xml_events

_TEXT = {271: "camera_make", 272: "camera_model", 305: "software", 315: "artist", 33432: "copyright", 270: "image_description", 42036: "lens_model"}
_NUMBER = {274: "orientation", 34855: "iso", 40962: "pixel_x_dimension", 40963: "pixel_y_dimension"}
_FLOAT = {37386: "focal_length_mm", 33437: "f_number", 33434: "exposure_time_sec", 37380: "exposure_bias", 41989: "focal_length_35mm"}
_DATE = {36867: "datetime_original", 306: "datetime", 36868: "datetime_digitized"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


class Tiff:
    """Directories of a TIFF structure; offsets that lead outside, or back, end the walk."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8 or struct.unpack_from(self.order + "H", data, 2)[0] != 42:
            raise Corrupted("no TIFF header")
        self.first = struct.unpack_from(self.order + "I", data, 4)[0]

    def directory(self, at: int) -> tuple[dict[int, list], int]:
        entries: dict[int, list] = {}
        if at + 2 > len(self.data) or at < 8:
            return entries, 0
        n = struct.unpack_from(self.order + "H", self.data, at)[0]
        for k in range(n):
            place = at + 2 + 12 * k
            if place + 12 > len(self.data):
                return entries, 0
            tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, place)
            size = _SIZES.get(kind, 0) * count
            start = place + 8 if size <= 4 else struct.unpack_from(self.order + "I", self.data, place + 8)[0]
            if size and start + size <= len(self.data):
                entries[tag] = self.values(kind, count, self.data[start : start + size])
        end = at + 2 + 12 * n
        return entries, struct.unpack_from(self.order + "I", self.data, end)[0] if end + 4 <= len(self.data) else 0

    def values(self, kind: int, count: int, raw: bytes) -> list:
        if kind in (2, 7):
            return [raw]
        if kind in (5, 10):
            flat = struct.unpack(f"{self.order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            return [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2])]
        return list(struct.unpack(f"{self.order}{count}{_CODES[kind]}", raw))

    def chain(self) -> list[dict[int, list]]:
        out, seen, at = [], set(), self.first
        while at and at not in seen:
            seen.add(at)
            entries, at = self.directory(at)
            if not entries:
                break
            out.append(entries)
        return out


def gps_decimal(values: list, ref: str) -> float | None:
    """Degrees, minutes and seconds as degrees; south and west are negative."""
    if len(values) < 3:
        return None
    value = values[0] + values[1] / 60 + values[2] / 3600
    return -value if ref.upper() in ("S", "W") else value


def exif(data: bytes) -> dict:
    """Metadata of an EXIF block; empty if it can't be read."""
    try:
        tiff = Tiff(data)
        main = tiff.directory(tiff.first)[0]
        tags = dict(main)
        if 34665 in main:
            tags |= tiff.directory(int(main[34665][0]))[0]
        gps = tiff.directory(int(main[34853][0]))[0] if 34853 in main else {}
    except (Corrupted, struct.error):
        return {}
    out: dict = {}
    said = lambda v: v[0].split(b"\0")[0].decode("utf-8", "replace") if v and isinstance(v[0], bytes) else ""
    for tag, values in tags.items():
        v = values[0] if values else None
        if tag in _TEXT and said(values):
            out[_TEXT[tag]] = said(values)
        elif tag in _NUMBER and isinstance(v, int):
            out[_NUMBER[tag]] = v
        elif tag in _FLOAT and isinstance(v, (int, float)):
            out[_FLOAT[tag]] = float(v)
        elif tag in _DATE:
            try:
                out[_DATE[tag]] = datetime.datetime.strptime(said(values), "%Y:%m:%d %H:%M:%S").replace(tzinfo=datetime.timezone.utc)
            except ValueError:
                pass
    for value, ref, key in ((2, 1, "gps_latitude"), (4, 3, "gps_longitude")):
        place = gps_decimal([x for x in gps.get(value, []) if not isinstance(x, bytes)], said(gps.get(ref, [])))
        if place is not None:
            out[key] = place
    return out | {"exif_present": True}


def jpeg(data: bytes) -> Parsed:
    if not data.startswith(b"\xff\xd8"):
        raise Corrupted("no JPEG header")
    at, meta, extra = 2, None, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark in (0xD9, 0xDA):
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            height, width, parts = struct.unpack_from(">HHB", body, 1)
            meta = {"width": width, "height": height, "color_type": {1: "L8", 3: "Rgb8", 4: "Rgb8"}.get(parts, f"{parts} components")}
        elif mark == 0xE1 and body.startswith(b"Exif\0\0") and not extra:
            extra = exif(body[6:])
        at += 2 + n
    if meta is None:
        raise Corrupted("JPEG without a frame header")
    return None, meta | extra


def png_chunks(data: bytes) -> list[tuple[str, bytes]]:
    """Chunks up to the first that is cut off; checksums aren't looked at."""
    out, at = [], 8
    while at + 8 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        if at + 8 + n > len(data):
            break
        out.append((data[at + 4 : at + 8].decode("latin-1"), data[at + 8 : at + 8 + n]))
        at += 12 + n
    return out


def _inflated(data: bytes) -> bytes | None:
    try:
        return zlib.decompressobj().decompress(data, 64 << 20)
    except zlib.error:
        return None


def png_texts(data: bytes) -> list[tuple[str, str, str]]:
    """(kind, keyword, text) of the text chunks."""
    out = []
    for kind, body in png_chunks(data):
        key, mark, rest = body.partition(b"\0")
        if not mark or kind not in ("tEXt", "zTXt", "iTXt"):
            continue
        if kind == "tEXt":
            text: bytes | None = rest
        elif kind == "zTXt":
            text = _inflated(rest[1:])
        else:
            if len(rest) < 2:
                continue
            packed, rest = rest[0] == 1, rest[2:]
            rest = rest.split(b"\0", 2)[2] if rest.count(b"\0") >= 2 else b""
            text = _inflated(rest) if packed else rest
        if text is not None:
            out.append((kind, key.decode("utf-8", "replace"), text.decode("utf-8", "replace")))
    return out


def png(data: bytes) -> Parsed:
    if not data.startswith(b"\x89PNG\r\n\x1a\n") or data[12:16] != b"IHDR" or len(data) < 29:
        raise Corrupted("no PNG header")
    width, height, depth, color = struct.unpack_from(">IIBB", data, 16)
    names = {0: "L", 2: "Rgb", 3: "Rgb", 4: "La", 6: "Rgba"}
    meta: dict = {"width": width, "height": height, "color_type": f"{names.get(color, color)}{16 if depth == 16 else 8}"}
    for kind, key, text in png_texts(data):
        meta[{"tEXt": "text_", "zTXt": "ztext_", "iTXt": "itext_"}[kind] + key] = text
    return None, meta


def tiff(data: bytes) -> Parsed:
    t = Tiff(data)
    pages = t.chain()
    if not pages:
        raise Corrupted("TIFF without a directory")
    first = pages[0]
    one = lambda tag, default=0: int(first[tag][0]) if first.get(tag) and not isinstance(first[tag][0], bytes) else default
    depth, samples = one(258, 1), one(277, 1)
    meta: dict = {"width": one(256), "height": one(257), "color_type": f"{ {1: 'L', 2: 'La', 3: 'Rgb', 4: 'Rgba'}.get(samples, samples) }{16 if depth == 16 else 8}".replace(" ", "")}
    meta |= {"byte_order": "little-endian" if t.order == "<" else "big-endian", "page_count": len(pages)}
    if len(pages) > 1:
        meta["multi_page"] = True
    return None, meta | ({k: v for k, v in exif(data).items()} if 34665 in first or 34853 in first or 271 in first else {})


def webp(data: bytes) -> Parsed:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupted("no WebP header")
    at, meta, extra = 12, None, {}
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + n]
        if kind == b"VP8X" and len(body) >= 10:
            meta = {"width": int.from_bytes(body[4:7], "little") + 1, "height": int.from_bytes(body[7:10], "little") + 1, "color_type": "Rgba8" if body[0] & 16 else "Rgb8"}
        elif kind == b"VP8 " and len(body) >= 10 and meta is None:
            width, height = struct.unpack_from("<HH", body, 6)
            meta = {"width": width & 0x3FFF, "height": height & 0x3FFF, "color_type": "Rgb8"}
        elif kind == b"VP8L" and len(body) >= 5 and meta is None:
            bits = int.from_bytes(body[1:5], "little")
            meta = {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "color_type": "Rgba8" if bits >> 28 & 1 else "Rgb8"}
        elif kind == b"EXIF":
            extra = exif(body.removeprefix(b"Exif\0\0"))
        at += 8 + n + (n & 1)
    if meta is None:
        raise Corrupted("WebP without an image header")
    return None, meta | extra


_SHAPES = frozenset("path rect circle ellipse line polyline polygon g use image".split())


def svg(data: bytes) -> Parsed:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Failure(f"drawing isn't UTF-8: {e}") from None
    meta: dict = {}
    out: list[str] = []
    held = {"title": "", "desc": ""}
    state = {"root": False, "in": ""}

    def start(name, attrs):
        name = local(name)
        if name == "svg" and not state["root"]:
            state["root"] = True
            for k, v in attrs.items():
                key = {"viewBox": "viewbox", "width": "width", "height": "height", "xmlns": "xmlns"}.get(local(k))
                if key and (key != "xmlns" or k == "xmlns"):
                    meta[key] = v
        if name in ("title", "desc", "text"):
            state["in"] = name
        elif name in _SHAPES:
            key = f"element_{name}_count"
            meta[key] = meta.get(key, 0) + 1

    def end(name):
        name = local(name)
        if name in held:
            key = "title" if name == "title" else "description"
            if held[name].strip():
                meta.setdefault(key, held[name].strip())
            held[name] = ""
        elif name == "text":
            out.append("\n")
        if name == state["in"]:
            state["in"] = ""

    def more(t):
        if state["in"] in held:
            held[state["in"]] += t
        elif state["in"] == "text" and t.strip():
            out.append(t.strip() + " ")

    xml_events(data, start, end, more)
    if not state["root"]:
        raise Failure("no svg element")
    text = "".join(out).strip()
    return text or None, meta


_GENRES = "Blues,Classic Rock,Country,Dance,Disco,Funk,Grunge,Hip-Hop,Jazz,Metal,New Age,Oldies,Other,Pop,R&B,Rap,Reggae,Rock,Techno,Industrial,Alternative,Ska,Death Metal,Pranks,Soundtrack,Euro-Techno,Ambient,Trip-Hop,Vocal,Jazz+Funk,Fusion,Trance,Classical,Instrumental,Acid,House,Game,Sound Clip,Gospel,Noise".split(",")
_FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TCON": "genre", "TT2": "title", "TP1": "artist", "TAL": "album", "TP2": "album_artist", "TCO": "genre"}
_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _said(body: bytes, code: int) -> str:
    return body.decode(_ENCODINGS.get(code, "latin-1"), "replace").strip("\0").replace("\0", "/")


def mp3(data: bytes) -> Parsed:
    meta: dict = {}
    comments: list[str] = []
    if data[:3] == b"ID3" and len(data) >= 10:
        version, flags = data[3], data[5]
        size = lambda b, safe: sum(x << (7 if safe else 8) * k for k, x in enumerate(reversed(b)))
        end = min(len(data), 10 + size(data[6:10], True))
        tag = data[10:end]
        if flags & 0x80 and version < 4:
            tag = tag.replace(b"\xff\x00", b"\xff")
        at = 0
        if flags & 0x40 and len(tag) > 4:
            at = size(tag[:4], version == 4) + (0 if version == 4 else 4)
        head = 6 if version == 2 else 10
        while at + head <= len(tag) and tag[at]:
            name = tag[at : at + (3 if version == 2 else 4)].decode("latin-1")
            n = size(tag[at + 3 : at + 6], False) if version == 2 else size(tag[at + 4 : at + 8], version == 4)
            body = tag[at + head : at + head + n]
            at += head + n
            if not body:
                continue
            if name in ("COMM", "COM") and len(body) > 4:
                rest = body[4:]
                wide = body[0] in (1, 2)
                cut = next((k for k in range(0, len(rest) - 1, 2) if rest[k : k + 2] == b"\0\0"), -2) + 2 if wide else rest.find(b"\0") + 1
                t = _said(rest[cut:], body[0])
                if t.strip():
                    comments.append(t)
            elif name[0] == "T":
                t = _said(body[1:], body[0])
                if name in _FRAMES:
                    if _FRAMES[name] == "genre" and (m := re.fullmatch(r"\(?(\d+)\)?", t)) and int(m[1]) < len(_GENRES):
                        t = _GENRES[int(m[1])]
                    meta[_FRAMES[name]] = t
                elif name in ("TDRC", "TYER", "TYE") and re.match(r"\d{4}", t):
                    meta["year"] = int(t[:4])
                elif name in ("TRCK", "TRK") and (m := re.match(r"(\d+)(?:/(\d+))?", t)):
                    meta["track"] = int(m[1])
                    if m[2]:
                        meta["total_tracks"] = int(m[2])
                elif name in ("TPOS", "TPA") and (m := re.match(r"\d+", t)):
                    meta["disc"] = int(m[0])
                elif name in ("TLEN", "TLE") and t.isdigit():
                    meta["duration_ms"] = int(t)
    elif data[-128:-125] == b"TAG":
        tag = data[-125:]
        cut = lambda a, b: tag[a:b].split(b"\0")[0].decode("latin-1").strip()
        meta = {k: v for k, v in (("title", cut(0, 30)), ("artist", cut(30, 60)), ("album", cut(60, 90))) if v}
        if cut(90, 94).isdigit():
            meta["year"] = int(cut(90, 94))
        if cut(94, 124):
            comments.append(cut(94, 122 if tag[122] == 0 and tag[123] else 124))
        if tag[122] == 0 and tag[123]:
            meta["track"] = tag[123]
        if tag[124] < len(_GENRES):
            meta["genre"] = _GENRES[tag[124]]
    else:
        raise Failure("no ID3 tag")
    return "\n".join(comments).strip() or None, meta
