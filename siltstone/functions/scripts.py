"""Scripts and letter pairs of texts: one pass over the code points of a batch, whatever the number of scripts and pairs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ocr.language import FLOOR, LOGS

#: Code points of each script, in the order that decides between equals.
CLASSES = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "Greek": ((0x370, 0x3FF),), "Cyrillic": ((0x400, 0x4FF),), "Hebrew": ((0x590, 0x5FF),), "Arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "Devanagari": ((0x900, 0x97F),), "Hiragana": ((0x3040, 0x309F),), "Katakana": ((0x30A0, 0x30FF),), "Han": ((0x4E00, 0x9FFF),), "Hangul": ((0xAC00, 0xD7AF),), "Digit": ((0x30, 0x39),),
}
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def sql_class(script: str) -> str:
    return _class(CLASSES[script])


SQL_SPACE = _class(SPACES)


#: Code points that are looked at together; a longer text comes by itself.
POINTS = 1 << 20


def _points(texts: pd.Series):
    """(rows, code points, row of each) of the texts, about POINTS at a time; nulls are left out."""
    rows: list[int] = []
    size = 0

    def give():
        part = [texts.iloc[k] for k in rows]
        return np.array(rows), np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4"), np.repeat(np.arange(len(rows)), [len(t) for t in part])

    for k, t in enumerate(texts):
        if t is None:
            continue
        if rows and size + len(t) > POINTS:
            yield give()
            rows, size = [], 0
        rows.append(k)
        size += len(t)
    if rows:
        yield give()


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """Place of each code point's script; the last but one for others, the last for white space."""
    out = np.full(0x110000, len(CLASSES), dtype=np.uint8)
    for ranges, k in ((SPACES, len(CLASSES) + 1), *((r, k) for k, r in enumerate(CLASSES.values()))):
        for a, b in ranges:
            out[a : b + 1] = k
    return out


def _counted(texts: pd.Series) -> pd.Series:
    wide = len(CLASSES) + 2
    out: list = [None] * len(texts)
    for rows, points, own in _points(texts):
        found = np.bincount(own * wide + _script_of()[points], minlength=len(rows) * wide).reshape(-1, wide)
        for k, n in zip(rows, found):
            out[k] = n[:-1]
    return pd.Series(out, dtype=object)


def histogram(text: Column) -> Column:
    """array<struct<script, n>> of the characters that aren't white space; scripts that don't occur are left out."""
    names = F.array(*map(F.lit, (*CLASSES, "Other")))
    every = F.zip_with(names, F.pandas_udf(_counted, "array<long>")(text), lambda s, n: F.struct(s.alias("script"), n.alias("n")))
    return F.filter(every, lambda e: e["n"] > 0)


def dominant(text: Column) -> Column:
    """The most frequent script but digits and others; null without any, the earlier of equal ones."""
    order = {s: -k for k, s in enumerate(CLASSES)}
    places = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    real = F.filter(histogram(text), lambda e: ~e["script"].isin("Digit", "Other"))
    return F.array_max(F.transform(real, lambda e: F.struct(e["n"], places[e["script"]].alias("place"), e["script"].alias("script"))))["script"]


@lru_cache(maxsize=1)
def _pair_logs() -> tuple[np.ndarray, np.ndarray]:
    """(place of each character below 128 among those of the pairs, logarithm of each two places); place 0 is any other character."""
    names = sorted({c for p in LOGS for c in p})
    place = np.zeros(128, dtype=np.int64)
    for k, c in enumerate(names, 1):
        place[ord(c)] = k
    logs = np.full((len(names) + 1, len(names) + 1), float(FLOOR))
    for p, v in LOGS.items():
        logs[place[ord(p[0])], place[ord(p[1])]] = v
    return place, logs


def _pairs_of(texts: pd.Series) -> pd.Series:
    place, logs = _pair_logs()
    out = np.full(len(texts), np.nan)
    for rows, points, own in _points(texts):
        at = np.where(points < 128, place[np.minimum(points, 127)], 0)
        inside = own[1:] == own[:-1]
        total = np.bincount(own[1:][inside], weights=logs[at[:-1], at[1:]][inside], minlength=len(rows))
        out[rows] = total / np.maximum(np.bincount(own, minlength=len(rows)) - 1, 1)
    return pd.Series(out)


def pair_score(text: Column) -> Column:
    """Mean logarithm of a text's letter pairs, 0 for a text without any; null for null."""
    return F.when(text.isNotNull(), F.pandas_udf(_pairs_of, "double")(F.lower(text)))
