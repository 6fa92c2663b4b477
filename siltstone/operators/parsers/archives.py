"""Archive listings."""

from __future__ import annotations

import datetime
import io
import re
import tarfile
import zipfile

from .base import Corrupted, Parsed


def safe_path(path: str) -> bool:
    return not (not path or re.search(r"(^|[/\\])\.\.([/\\]|$)", path) or path[0] in "/\\" or re.match(r"[A-Za-z]:", path))


def zip_entries(data: bytes) -> list[tuple[str, int, int]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, i.file_size, i.compress_size) for i in z.infolist()]
    except Exception as e:
        raise Corrupted(f"not a ZIP archive: {e}") from None


def tar_entries(data: bytes) -> list[tuple[str, int, str]]:
    """(path, size, time of change)."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
            stamp = lambda m: datetime.datetime.fromtimestamp(m, datetime.timezone.utc).isoformat(timespec="seconds")
            return [(m.name + "/" * m.isdir(), m.size, stamp(m.mtime)) for m in t]
    except Exception as e:
        raise Corrupted(f"not a TAR archive: {e}") from None


def _listing(kind: str, lines: list[str]) -> str:
    return f"{kind} Archive Contents ({len(lines)} files):\n" + "\n".join(lines) if lines else f"Empty {kind} archive"


def zip_(data: bytes) -> Parsed:
    found = zip_entries(data)
    total, packed = sum(s for _, s, _ in found), sum(c for *_, c in found)
    names = [n for n, *_ in found]
    meta = {"file_count": len(found), "total_size": total, "compressed_size": packed, "compression_ratio": packed / total if total else 0.0, "contains_unsafe_paths": not all(map(safe_path, names)), "files": names}
    return _listing("ZIP", names), meta


def tar(data: bytes) -> Parsed:
    found = tar_entries(data)
    meta = {"file_count": len(found), "total_size": sum(s for _, s, _ in found), "contains_unsafe_paths": not all(safe_path(n) for n, *_ in found), "files": [f"{n} (size: {s}, modified: {t})" for n, s, t in found]}
    return _listing("TAR", [f"{n} ({s} bytes)" for n, s, _ in found]), meta
