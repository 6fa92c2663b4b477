"""Guards against oversized, exploding or escaping inputs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import MIB, SIZE_LIMITS

ZIP_TOTAL, ZIP_RATIO, ENTITIES, ENTITY_REFS = 500 * MIB, 100, 10_000, 10


def safe_archive_path(path: Column) -> Column:
    """False for empty and absolute paths, drive letters, and any step to a parent."""
    return ~((path == "") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:"))


def size_limit(mime: Column, scale: float = 1) -> Column:
    """Largest size that a format's parser takes, null without one."""
    return F.try_element_at(F.create_map(*[x for m, n in SIZE_LIMITS.items() for x in (F.lit(m), F.lit(int(n * scale)).cast("long"))]), mime)


def too_large(mime: Column, size: Column, scale: float = 1) -> Column:
    return F.coalesce(size > size_limit(mime, scale), F.lit(False))


def zip_bomb(total: Column, compressed: Column) -> Column:
    """By the sums of an archive's uncompressed and compressed sizes."""
    return (total > ZIP_TOTAL) | ((compressed > 0) & (total / F.nullif(compressed, F.lit(0)) > ZIP_RATIO))


def xml_bomb(text: Column) -> Column:
    """Too many entity declarations, or one that expands many others in its line."""
    mark = F.lit("<!ENTITY")
    count = (F.length(text) - F.length(F.replace(text, mark, F.lit("")))) / 8
    nested = F.exists(F.split(text, "\n"), lambda s: F.contains(s, mark) & (F.length(s) - F.length(F.replace(s, F.lit("&"), F.lit(""))) > ENTITY_REFS))
    return F.contains(text, mark) & ((count > ENTITIES) | nested)


def missing_members(names: Column, required: list[str]) -> Column:
    """Members that an archive should have and hasn't."""
    return F.array_except(F.array(*map(F.lit, required)), names)
