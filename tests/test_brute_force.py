"""Queries without SQL against slow second versions of them, on the smallest tables."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import neighbours, spelling
from siltstone.operators.ocr import engine, glyphs, images, language, layout, pixels
from siltstone.plans import catalogue, ocr_queries
from siltstone.sources import packages

QUERIES = catalogue.queries()


def test_region_lines(spark, sf):
    """Lines of every image, each region placed by looking at the members of every line anew."""
    rows = defaultdict(list)
    for r in ocr_queries.boxes(spark, sf).collect():
        rows[r.image].append((r.y, r.x, r.h, r.w, r.id))
    got = {(r.image, r.id): r.line for r in QUERIES["region_lines"](spark, sf).collect()}
    assert len(got) == sum(map(len, rows.values()))
    for image, own in rows.items():
        lines: list[list[tuple]] = []
        boxes: dict = {}
        for y, x, h, w, i in own:
            boxes.setdefault((y, x, h, w), []).append(i)
        order = {b: min(i) for b, i in boxes.items()}
        for y, x, h, w in sorted(boxes, key=lambda b: (b[0], b[1], order[b])):
            for line in lines:
                top, end = min(b[0] for b in line), max(b[0] + b[2] for b in line)
                if max(0, min(end, y + h) - max(top, y)) >= 0.5 * min(max(1, h), max(1, end - top)):
                    line.append((y, x, h, w))
                    break
            else:
                lines.append([(y, x, h, w)])
        lines.sort(key=lambda line: min(b[0] for b in line))
        assert all(got[image, i] == k for k, line in enumerate(lines) for b in line for i in boxes[b])


def test_nms(spark, sf):
    rows = defaultdict(list)
    for r in ocr_queries.boxes(spark, sf).collect():
        rows[r.image].append((r.id, (r.x, r.y, r.w, r.h)))
    want = set()
    for image, own in rows.items():
        kept: list = []
        for i, b in sorted(own, key=lambda r: (-r[1][2] * r[1][3], r[0])):
            if all(layout.iou(b, k) <= 0.3 for _, k in kept):
                kept.append((i, b))
        want |= {(image, i) for i, _ in kept}
    assert {(r.image, r.id) for r in QUERIES["nms"](spark, sf).collect()} == want


def test_k_means(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy(F.xxhash64(F.lit(neighbours.SEED), "vec_id"), "vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    centres = x[:8].copy()
    nearest = lambda: np.array([min(range(8), key=lambda k: (((v - centres[k]) ** 2).sum(), k)) for v in x])
    for _ in range(10):
        own = nearest()
        centres = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(8)])
    want = {r.vec_id: int(c) for r, c in zip(rows, nearest())}
    assert {r.vec_id: r.cluster for r in QUERIES["k_means"](spark, sf).collect()} == want


def test_k_medoids(spark, sf):
    """No exchange of a medoid for another row of the label lowers the cost."""
    rows = defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        rows[r.label][r.vec_id] = np.array(r.embedding, dtype=np.float64)
    chosen = defaultdict(list)
    for r in QUERIES["k_medoids"](spark, sf).collect():
        chosen[r.label].append(r.vec_id)
    assert set(chosen) == set(rows)
    for label, own in rows.items():
        ids = sorted(own)
        d = np.array([[np.sqrt(((own[a] - own[b]) ** 2).sum()) for b in ids] for a in ids])
        cost = lambda picks: d[:, [ids.index(i) for i in picks]].min(axis=1).sum()  # noqa: B023, E731
        picks = chosen[label]
        assert len(set(picks)) == min(4, len(ids))
        assert all(cost([*picks[:k], j, *picks[k + 1 :]]) >= cost(picks) - 1e-6 for k in range(len(picks)) for j in ids if j not in picks)


def pair_sum(glyph_rows, text, weights=None):
    return sum(-dict(row)[c] for row, c in zip(glyph_rows, text))


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_and_beam_are_exhaustive(seed):
    rng = np.random.default_rng(seed)
    rows = [[(c, float(rng.random())) for c in rng.choice(list("theandior "), 3, replace=False)] for _ in range(6)]
    known = language.Vocabulary(["the", "then", "on", "and"])
    every = ["".join(t) for t in itertools.product(*[[c for c, _ in r] for r in rows])]

    def plain(t):
        return pair_sum(rows, t) + sum(language.PAIR_WEIGHT * language.pair_log(a, b) for a, b in zip(t, t[1:]))

    def helped(t):
        return pair_sum(rows, t) + sum(language.PAIR_WEIGHT * language.pair_log(t[k - 1] if k else " ", t[k]) + language.WORD_WEIGHT * known.bonus(t[: k + 1]) for k in range(len(t)))

    assert plain(language.viterbi(rows)) == pytest.approx(max(map(plain, every)))
    assert helped(language.beam(rows, known, width=3**6)) == pytest.approx(max(map(helped, every)))


def test_beam_has_one_vocabulary(spark, sf):
    """The answer doesn't depend on how the table is dealt into batches."""
    want = {r.item_id: r.text for r in QUERIES["beam"](spark, sf).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert {r.item_id: r.text for r in QUERIES["beam"](spark, sf).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_neighbours_in_blocks(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    rows = sorted((r.vec_id, r.label, np.array(r.embedding, dtype=np.float64)) for r in vectors.collect())
    want = {}
    for q, _, x in rows:
        if q % 20 == 0:
            best = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, _, y in rows if i != q)[:5]
            want |= {(q, k + 1): i for k, (_, i) in enumerate(best)}
    for shard, block in ((1 << 16, 1 << 13), (7, 2)):
        assert {(r.query_id, r["rank"]): r.vec_id for r in neighbours.exact(vectors, asked, 5, shard, block).collect()} == want


def test_corrected_texts(spark):
    rows = spark.createDataFrame([(1, "Teh quick, browm fox!\nJumps"), (2, ""), (3, None), (4, "fox fxo  42 é")], "k int, t string")
    known = spark.createDataFrame([("the", 9), ("quick", 5), ("brown", 4), ("fox", 4), ("jumps", 3)], "word string, n long")
    got = {r.k: r.t for r in spelling.corrected(rows, "k", "t", known).collect()}
    assert got == {1: "The quick, brown fox!\nJumps", 2: "", 3: None, 4: "fox fox  42 fox"} or got[4] == "fox fox  42 é"
    assert got[1] == "The quick, brown fox!\nJumps"


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (30, 41)])
def test_png_round_trip(shape):
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, shape, dtype=np.uint8)
    assert (images.read_png(packages.png_of_pixels(img)) == img).all()


def png_bytes(width, height, depth, color, rows, extra=b"", interlaced=0):
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_kinds():
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    one_bit = images.read_png(png_bytes(10, 1, 1, 0, b"\0\xa5\x40"))
    assert one_bit.tolist() == [[255, 0, 255, 0, 0, 255, 0, 255, 0, 255]]
    palette = images.read_png(png_bytes(2, 1, 2, 3, b"\0\x60", chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9])) + chunk(b"tRNS", b"\xff\x00")))
    assert palette.tolist() == [[[255, 255, 255], [7, 8, 9]]]
    deep = images.read_png(png_bytes(1, 1, 16, 2, b"\0\x11\x00\x22\x00\x33\x00"))
    assert deep.tolist() == [[[0x11, 0x22, 0x33]]]
    clear = images.read_png(png_bytes(1, 1, 8, 6, b"\0\x00\x00\x00\x80"))
    assert clear[0, 0].tolist() == [127, 127, 127]
    img = np.arange(64, dtype=np.uint8).reshape(8, 8)
    passes = b"".join(b"".join(b"\0" + img[y, x0::dx].tobytes() for y in range(y0, 8, dy)) for x0, y0, dx, dy in images.PASSES)
    assert (images.read_png(png_bytes(8, 8, 8, 0, passes, interlaced=1)) == img).all()
    for broken in (b"", b"\x89PNG", png_bytes(4, 4, 8, 0, b"\0\1"), png_bytes(0, 4, 8, 0, b""), png_bytes(1, 1, 8, 3, b"\0\5")):
        with pytest.raises(ValueError):
            images.decode(broken) if broken else images.read_png(broken)


def test_settings_of_recognition():
    assert not engine.configured({}.get).enabled and not engine.configured({"siltstone.ocr": "off"}.get).enabled
    c = engine.configured({"siltstone.ocr": "classical", "siltstone.ocr.min_confidence": "0.4", "siltstone.ocr.layout": "mser", "siltstone.ocr.auto_rotate": "1", "siltstone.ocr.line_filter": "on"}.get)
    assert c.enabled and c.least == 0.4 and c.regions is layout.stable_regions and c.turn and len(c.keep) == 1
    for k, v in (("siltstone.ocr", "ml"), ("siltstone.ocr.layout", "x"), ("siltstone.ocr.min_confidence", "high")):
        with pytest.raises(ValueError):
            engine.configured({"siltstone.ocr": "on", k: v}.get)


def test_images_are_read_when_a_session_says_so(spark):
    from siltstone.operators.extract import extract

    rows = spark.createDataFrame([(bytearray(packages.png_of_pixels(glyphs.rendered("HELLO"))),), (bytearray(packages.png_of_pixels(np.full((20, 20), 255, np.uint8))),), (bytearray(packages.jpeg(5, 5)),)], "content binary")
    assert [r.text for r in extract(rows, "content").collect()] == [None, None, None]
    spark.conf.set("siltstone.ocr", "classical")
    try:
        got = [(r.text, {k: r.metadata[k] for k in sorted(r.metadata) if k.startswith("ocr")}) for r in extract(rows, "content").collect()]
    finally:
        spark.conf.unset("siltstone.ocr")
    assert got[0][0] == "HELLO" and got[0][1]["ocr_status"]["text"] == "recognized" and got[0][1]["ocr_applied"]["boolean"]
    assert got[1][0] is None and got[1][1]["ocr_status"]["text"] == "no_text_found" and got[1][1]["ocr_regions"]["number"] == 0
    assert got[2][0] is None and got[2][1]["ocr_status"]["text"] == "error" and "decoder" in got[2][1]["ocr_error"]["text"]


def test_broken_archives_say_so(spark):
    from siltstone.operators import tables

    tables.register(spark)
    whole = packages.archive_tar([1, 2], ["A", "B"])
    files = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"no archive")), (3, None)], "k int, content binary")
    got = [(r.k, r.path, r.error is None) for r in spark.sql("SELECT f.k, t.path, t.error FROM {files} f, LATERAL zip_entries(f.content) t", files=files).collect()]
    assert (2, None, False) in got and all(k != 3 for k, *_ in got)
    got = [(r.k, r.path, r.error is None) for r in spark.sql("SELECT f.k, t.path, t.error FROM {files} f, LATERAL tar_entries(f.content) t", files=files).collect()]
    assert (1, "nation/A.txt", True) in got and (2, None, False) in got


def test_pixel_kernels_against_loops():
    """Windows of every pixel, one by one."""
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (23, 31), dtype=np.uint8)
    h, w = img.shape

    def windows(radius):
        for y in range(h):
            for x in range(w):
                yield y, x, img[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].astype(float)

    mean, sauvola = np.zeros(img.shape), np.zeros(img.shape)
    for y, x, v in windows(4):
        mean[y, x] = 255 if img[y, x] > v.mean() - 10 else 0
        sauvola[y, x] = 255 if img[y, x] > v.mean() * (1 + 0.2 * (v.std() / 128 - 1)) else 0
    assert (pixels.adaptive_mean(img, 4, 10) == mean).mean() > 0.99 and (pixels.sauvola(img, 4) == sauvola).mean() > 0.99
    low, high = np.zeros(img.shape), np.zeros(img.shape)
    for y, x, v in windows(1):
        low[y, x], high[y, x] = v.min(), v.max()
    assert (pixels.erode(img, 1) == low).all() and (pixels.dilate(img, 1) == high).all()
    best = max(range(256), key=lambda t: (img <= t).mean() * (img > t).mean() * (img[img <= t].mean() - img[img > t].mean()) ** 2 if 0 < (img <= t).sum() < img.size else -1)
    assert abs(pixels.otsu_level(img) - best) <= 1
    ink = rng.random((9, 11)) < 0.6
    far = layout.city_distance(ink)
    for y in range(9):
        for x in range(11):
            other = [abs(y - a) + abs(x - b) for a in range(-1, 10) for b in range(-1, 12) if not (0 <= a < 9 and 0 <= b < 11 and ink[a, b])]
            assert far[y, x] == (min(other) if ink[y, x] else 0)
    found = layout.stroke_regions(glyphs.rendered("HI", 6))  # the bar of the H is wider than a stroke may be, the I stands
    assert found and all(b[2] > 4 and b[3] > 4 for b in found)
