"""Text of images: one function of parts that can be exchanged, and its Spark stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import glyphs, images, language, layout, pixels
from .images import pgm, read_pgm  # noqa: F401

RESULT = "struct<status:string,text:string,confidence:double,regions:int,error:string>"


@dataclass
class Config:
    """Parts and thresholds; each part is a function that may be replaced."""

    prepare: Callable[[np.ndarray], np.ndarray] = lambda img: pixels.preprocess(img, median_radius=0, deskew=False)
    regions: Callable[[np.ndarray], list] = layout.components
    keep: tuple[Callable[[list], list], ...] = ()
    prototypes: Callable[[], glyphs.Prototypes] = glyphs.bundled
    height: int | None = 28
    neighbours: int = 3
    scale: float = 1.0
    least: float = 0.15
    gap: float = 0.4
    rerank: bool = False
    vocabulary: language.Vocabulary | None = None
    turn: bool = False
    enabled: bool = True
    after: tuple[Callable[[str], str], ...] = field(default=())


def single(img: np.ndarray, c: Config) -> tuple[str, float, int]:
    """(text, mean confidence, regions) of an image as it stands."""
    page = c.prepare(img)
    boxes = c.regions(page)
    for f in c.keep:
        boxes = f(boxes)
    if not boxes:
        return "", 0.0, 0
    names, far = c.prototypes().nearest(np.array([glyphs.features(glyphs.ink_of(page, b, c.height)) for b in boxes]), c.neighbours)
    said = {b: glyphs.vote(n.tolist(), d.tolist(), c.scale) for b, n, d in zip(boxes, names, far)}
    kept = [b for b in boxes if said[b][1] >= c.least]
    text = "\n".join(_line(line, said, c) for line in layout.lines(kept))
    for f in c.after:
        text = f(text)
    return text, float(np.mean([said[b][1] for b in kept])) if kept else 0.0, len(kept)


def _line(line: list, said: dict, c: Config) -> str:
    """Characters from the left; a gap of two fifths of the median width is a blank."""
    widths = sorted(b[2] for b in line)
    wide = max(1.0, c.gap * widths[len(widths) // 2])
    cands: list = []
    for k, b in enumerate(line):
        if k and b[0] - line[k - 1][0] - line[k - 1][2] >= wide:
            cands.append([(" ", 0.0)])
        cands.append(said[b][2] if c.rerank or c.vocabulary else [(said[b][0], 0.0)])
    if c.vocabulary:
        return language.beam(cands, c.vocabulary)
    return language.viterbi(cands) if c.rerank else "".join(x[0][0] for x in cands)


def recognise(img: np.ndarray, config: Config | None = None) -> tuple[str, float, int]:
    """As single(), or of the four ways up the best: bytes of text times confidence, the first of equal ones."""
    c = config or Config()
    if not c.turn:
        return single(img, c)
    tried = [single(np.rot90(img, -k), c) for k in range(4)]
    return max(tried, key=lambda t: len(t[0].strip().encode()) * t[1])


#: Spellings of switches and modes in settings.
ON, OFF = ("1", "true", "on", "yes"), ("", "0", "false", "off", "no", "none")
_LAYOUTS = {"cca": layout.components, "swt": layout.stroke_regions, "mser": layout.stable_regions, "whole": layout.whole_image}
PREFIX = "siltstone.ocr"


def configured(get: Callable[[str], str | None]) -> Config:
    """The engine that settings ask for; ``get`` gives a setting's text or None, as ``lambda k: spark.conf.get(k, None)`` or ``os.environ.get`` does.

    ``siltstone.ocr`` is off (also when unset) or classical; below it stand
    min_confidence, auto_rotate, bigram, neighbours, normalize_height, layout (cca,
    swt, mser, whole), line_filter, neighbor_min, stroke_filter, binarize (otsu, sauvola, adaptive,
    none), clahe, tophat, despeckle (a radius), bilateral, unsharp and deskew. A value
    that can't be read is an error, not a default.
    """

    def setting(name: str, default, read):
        raw = get(f"{PREFIX}.{name}")
        if raw is None or raw == "":
            return default
        try:
            return read(raw.strip().lower())
        except (ValueError, KeyError):
            raise ValueError(f"{PREFIX}.{name} can't be {raw!r}") from None

    def switch(raw: str) -> bool:
        if raw not in ON + OFF:
            raise ValueError(raw)
        return raw in ON

    mode = (get(PREFIX) or "").strip().lower()
    if mode not in (*ON, *OFF, "classical"):
        raise ValueError(f"{PREFIX} can't be {mode!r}: off or classical")
    steps = {
        "binarise": setting("binarize", "otsu", {m: m for m in ("otsu", "sauvola", "adaptive", "none")}.__getitem__), "contrast": setting("clahe", False, switch), "hat": setting("tophat", False, switch),
        "median_radius": setting("despeckle", 0, int), "denoise": setting("bilateral", False, switch), "sharpen": setting("unsharp", False, switch), "deskew": setting("deskew", False, switch),
    }
    keep: list = []
    near = setting("neighbor_min", 0, int)
    if near:
        keep.append(lambda boxes: layout.dense(boxes, near))
    if setting("line_filter", False, switch):
        keep.append(layout.text_lines)
    return Config(
        enabled=mode not in OFF, prepare=lambda img: pixels.preprocess(img, **steps), regions=setting("layout", layout.components, _LAYOUTS.__getitem__), keep=tuple(keep), least=setting("min_confidence", 0.15, float),
        neighbours=setting("neighbours", 3, int), height=setting("normalize_height", 28, int), rerank=setting("bigram", False, switch), turn=setting("auto_rotate", False, switch),
    )


def outcome(data: bytes | None, config: Config, decode: Callable[[bytes], np.ndarray] = images.decode) -> dict:
    out = {"status": None, "text": None, "confidence": None, "regions": None, "error": None}
    if data is None:
        return out
    if not config.enabled:
        return out | {"status": "disabled"}
    try:
        text, sure, n = recognise(decode(data), config)
    except Exception as e:
        return out | {"status": "error", "error": f"{type(e).__name__}: {e}"}
    return out | {"status": "recognized" if text.strip() else "no_text_found", "text": text, "confidence": sure, "regions": n}


def recognised(data: Column, config: Config | None = None, decode: Callable[[bytes], np.ndarray] = images.decode) -> Column:
    c = config or Config()

    @F.pandas_udf(RESULT)
    def run(images: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(b, c, decode) for b in images], columns=["status", "text", "confidence", "regions", "error"])

    return run(data)


def read_images(df: DataFrame, data: str, config: Config | None = None, decode: Callable[[bytes], np.ndarray] = images.decode) -> DataFrame:
    """The rows with ``ocr``. Each different image is read once: digests are joined back, so a hot image costs no more than another."""
    keyed = df.withColumn("_digest", F.sha2(F.col(data), 256))
    once = keyed.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.any_value(data).alias("_image"))
    found = once.select("_digest", recognised(F.col("_image"), config, decode).alias("ocr"))
    return keyed.join(found, "_digest", "left").drop("_digest")


def entries(found: dict) -> dict:
    """ocr_* entries of an outcome(), for a parser's metadata; none where recognition is switched off."""
    status = found["status"]
    if status in (None, "disabled"):
        return {}
    more = {"recognized": ("confidence",), "no_text_found": ("confidence", "regions"), "error": ("error",)}[status]
    return {"ocr_status": status, "ocr_applied": status == "recognized"} | {f"ocr_{k}": found[k] for k in more}


def with_text(mime: str, data: bytes, text: str | None, metadata: dict, config: Config | None) -> tuple[str | None, dict]:
    """A parser's result with what is recognised in an image, or, where a PDF has no text, in its embedded images."""
    if config is None or not config.enabled:
        return text, metadata
    if mime.startswith("image/") and mime != "image/svg+xml":
        found = outcome(data, config)
        return (found["text"] if found["status"] == "recognized" else text), metadata | entries(found)
    if mime == "application/pdf" and not (text or "").strip():
        from ..parsers.pdf import pictures

        every = pictures(data)
        if not every:
            return text, metadata | {"ocr_status": "no_embedded_images", "ocr_applied": False}
        found = [outcome(x, config) for x in every]
        said = [(k, f) for k, f in enumerate(found, 1) if f["status"] == "recognized"]
        meta = {"ocr_status": "recognized" if said else "no_text_found", "ocr_applied": bool(said), "ocr_image_count": len(every), "ocr_images_recognized": len(said)}
        if said:
            meta["ocr_confidence"] = sum(f["confidence"] for _, f in said) / len(said)
            text = "\n\n".join(f"[image {k} of {len(every)}]\n{f['text']}" for k, f in said)
        return text, metadata | meta
    return text, metadata


def as_metadata(ocr: Column) -> Column:
    """ocr_* entries by status; nothing where recognition is switched off."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    done = F.array(entry("ocr_status", ocr["status"]), entry("ocr_applied", F.lit(True)), entry("ocr_confidence", ocr["confidence"]))
    other = F.array(entry("ocr_status", ocr["status"]), entry("ocr_applied", F.lit(False)), entry("ocr_confidence", ocr["confidence"]), entry("ocr_regions", ocr["regions"]), entry("ocr_error", ocr["error"]))
    kept = F.when(ocr["status"] == "recognized", done).when(ocr["status"] == "disabled", F.array().cast("array<struct<key:string,value:string>>")).otherwise(other)
    return F.map_from_entries(F.filter(kept, lambda e: e["value"].isNotNull()))
