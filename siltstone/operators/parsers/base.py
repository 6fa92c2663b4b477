"""What all parsers share: errors, guards, XML events, ZIP access."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.parsers import expat

from ...functions.formats import MIB, SIZE_LIMITS
from ...functions.guards import ENTITIES, ENTITY_REFS, ZIP_RATIO, ZIP_TOTAL

#: What a parser gives: text (None if there is none) and metadata.
Parsed = tuple[str | None, dict]


class Failure(Exception):
    kind = "ParseError"


class Corrupted(Failure):
    kind = "CorruptedFile"


class Unsupported(Failure):
    kind = "UnsupportedFormat"


class TooLarge(Failure):
    kind = "Io"


def check_size(data: bytes, mime: str) -> None:
    limit = SIZE_LIMITS.get(mime)
    if limit is not None and len(data) > limit:
        raise Failure(f"{len(data)} bytes; {mime} is read up to {limit // MIB} MiB")


def check_entities(data: bytes) -> None:
    if b"<!ENTITY" not in data:
        return
    if data.count(b"<!ENTITY") > ENTITIES:
        raise Failure("too many entity declarations")
    if any(b"<!ENTITY" in line and line.count(b"&") > ENTITY_REFS for line in data.split(b"\n")):
        raise Failure("an entity expands many others")


def local(name: str) -> str:
    return name.rpartition(":")[2]


def xml_events(data: bytes, start: Callable | None = None, end: Callable | None = None, text: Callable | None = None) -> None:
    """Runs through a document; names keep their prefixes. Entities that it declares itself aren't expanded."""
    check_entities(data)
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.DefaultHandler = lambda _: None  # with it, internal entities stay as they are
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise Failure(f"XML: {e}") from None


class Archive:
    """A ZIP container, opened only if it can't explode; it may have to hold certain members."""

    def __init__(self, data: bytes, required: tuple[str, ...] = ()):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except Exception as e:
            raise Corrupted(f"not a ZIP archive: {e}") from None
        infos = self.zip.infolist()
        total, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
        if total > ZIP_TOTAL or packed and total / packed > ZIP_RATIO:
            raise Failure(f"archive expands from {packed} to {total} bytes")
        self.names = [i.filename for i in infos]
        for name in required:
            if name not in self.names:
                raise Corrupted(f"{name} is missing")

    def read(self, name: str) -> bytes:
        try:
            return self.zip.read(name)
        except KeyError:
            raise Corrupted(f"{name} is missing") from None
        except Exception as e:
            raise Corrupted(f"{name} can't be read: {e}") from None

    def get(self, name: str) -> bytes | None:
        return self.read(name) if name in self.names else None


def properties(data: bytes | None, fields: dict[str, str], numbers: tuple[str, ...] = ()) -> dict:
    """Metadata from the texts of elements, by local name; of several the last holds."""
    found: dict = {}
    if not data:
        return found
    stack: list[list] = []

    def start(name, _):
        stack.append([local(name), ""])

    def text(t):
        if stack:
            stack[-1][1] += t

    def end(_):
        name, value = stack.pop()
        key, value = fields.get(name), value.strip()
        if key and value:
            if key in numbers:
                try:
                    found[key] = int(value)
                except ValueError:
                    pass
            else:
                found[key] = value

    try:
        xml_events(data, start, end, text)
    except Failure:
        pass
    return found
