"""Sources, streams, sinks, plug-ins, table functions, recognition and regions on small fixtures."""

import numpy as np
import pytest

from siltstone.operators import neighbours, regions, registry, spelling
from siltstone.operators.extract import batch_summary, extract, parse
from siltstone.operators.ocr import engine, glyphs, language, layout, pixels
from siltstone.operators.parsers.base import Failure
from siltstone.sources import files, packages
from siltstone.streaming import folder


@pytest.fixture(scope="module")
def drop(tmp_path_factory):
    d = tmp_path_factory.mktemp("drop")
    made = {
        "a.txt": b"plain words\nsecond line\n", "b.json": b'{"k": [1, 2]}', "c.html": b"<html><head><title>T</title></head><body><p>x</p></body></html>", "d.docx": packages.docx([1], ["Hello"]),
        "e.pdf": packages.pdf(["Shown text"], "Title"), "f.bin": b"\x00\x01\xff\xfe\xfa", "g.json": b'{"cut', "copy.txt": b"plain words\nsecond line\n", "h.zip": packages.archive_zip([1], ["X"]),
    }
    for name, body in made.items():
        (d / name).write_bytes(body)
    return d


def test_files(spark, drop):
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract_files(spark, str(drop)).collect()}
    assert got["a.txt"].text == "plain words\nsecond line\n" and got["a.txt"].detected_by == "content_analysis"
    assert got["d.docx"].text == "Hello" and got["e.pdf"].text.strip() == "Shown text" and got["c.html"].metadata["title"].text == "T"
    assert got["g.json"].error.kind == "ParseError" and got["f.bin"].error.kind == "UnsupportedFormat" and got["h.zip"].metadata["file_count"].number == 1
    s = batch_summary(files.extract_files(spark, str(drop))).first()
    assert (s.total, s.succeeded, s.failed) == (9, 7, 2)


def test_stream_reads_each_content_once(spark, drop, tmp_path):
    q = folder.start(folder.extracted(spark, str(drop)), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and got.where("mime_type = 'application/pdf'").count() == 1


def test_null_and_odd_inputs(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xff\xfeh\x00i\x00")), (4, bytearray(b"PK\x03\x04broken")), (5, bytearray(b"{\\rtf1 x}"))], "id int, content binary")
    got = {r.id: r for r in extract(rows).collect()}
    assert got[1].mime_type is None and got[1].error is None and got[5].text.strip() == "x" and got[4].error is not None
    assert extract(rows.limit(0)).count() == 0


def test_own_parser():
    registry.register("application/x-own", lambda b: (b.decode().upper(), {"n": len(b)}))
    assert parse(b"abc", "application/x-own")["text"] == "ABC"

    def fails(_):
        raise Failure("no")

    registry.register("application/x-own", fails)
    assert parse(b"abc", "application/x-own")["error"] == {"kind": "ParseError", "message": "no"}
    del registry._parsers["application/x-own"]


def test_recognition_reads_its_own_glyphs():
    assert engine.recognise(glyphs.rendered("HELLO WORLD 42", 5))[0] == "HELLO WORLD 42"
    turned = np.rot90(glyphs.rendered("HELLO", 4), 1)
    assert engine.recognise(turned, engine.Config(turn=True))[0] == "HELLO"
    assert engine.outcome(b"P5\n3 3\n255\nxx", engine.Config())["status"] == "error" and engine.outcome(b"", engine.Config(enabled=False))["status"] == "disabled"
    assert glyphs.Prototypes.loaded(glyphs.bundled().saved()).names.tolist() == glyphs.bundled().names.tolist()
    assert all(len(glyphs.features(glyphs.bitmap(g))) == glyphs.SIZE for g in glyphs.GLYPHS) and [glyphs.holes(glyphs.bitmap(g)) for g in "8AC"] == [2, 1, 0]


def test_pixels():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    s, n = pixels.window_sums(pixels.integral(img), 2)
    assert s[0, 0] == img[:3, :3].sum() and n[0, 0] == 9 and s[10, 10] == img[8:13, 8:13].sum()
    assert pixels.erode(img)[5, 5] == img[4:7, 4:7].min() and pixels.median(img)[5, 5] == np.median(img[4:7, 4:7])
    page = np.where(rng.random((20, 30)) < 0.3, 20, 230).astype(np.uint8)
    assert ((pixels.otsu(page) == 0) == (page == 20)).all()
    for f in (pixels.clahe, pixels.bilateral, pixels.unsharp, pixels.top_hat, pixels.sauvola, pixels.adaptive_mean):
        assert f(img).shape == img.shape and f(img).dtype == np.uint8
    text = np.tile(glyphs.rendered("HELLO", 4), (3, 4))
    assert abs(abs(pixels.skew(pixels.rotate(text, 5))) - 5) <= 1 and pixels.skew(text) == 0
    rgb = np.full((20, 20, 3), 240, np.uint8)
    rgb[5:8, 5:8] = (200, 10, 10)
    assert (pixels.segment_text(rgb) == 0).sum() == 9


def test_layout_against_brute_force():
    rng = np.random.default_rng(2)
    ink = rng.random((12, 15)) < 0.4
    found, n = layout.labels(ink)
    seen = np.zeros(ink.shape, dtype=int)
    count = 0
    for y, x in zip(*np.nonzero(ink)):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 12 and 0 <= b < 15 and ink[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == count and len({(a, b) for a, b in zip(found[ink], seen[ink])}) == count
    d = layout.city_distance(np.ones((3, 5), dtype=bool))
    assert d.tolist() == [[1, 1, 1, 1, 1], [1, 2, 2, 2, 1], [1, 1, 1, 1, 1]]
    assert layout.iou((0, 0, 2, 2), (1, 0, 2, 2)) == pytest.approx(1 / 3) and layout.nms([(0, 0, 2, 2), (0, 0, 3, 2)], 0.5) == [(0, 0, 3, 2)]
    assert [[b[0] for b in line] for line in layout.lines([(9, 0, 2, 10), (0, 1, 2, 10), (3, 30, 2, 10)])] == [[0, 9], [3]]
    assert len(layout.stable_regions(glyphs.rendered("HELLO", 4))) == 5


def test_language():
    assert language.viterbi([[("z", 0.0), ("t", 0.1)], [("n", 0.0), ("h", 0.1)], [("e", 0.0)]]) == "the"
    words = language.Vocabulary(["the 10", "# note", "then"])
    assert (words.bonus("of the"), words.bonus("th"), words.bonus("q"), words.bonus("the ")) == (1.0, 0.2, 0.0, 0.0)
    assert language.beam([[("z", 0.0), ("t", 0.1)], [("n", 0.0), ("h", 0.1)], [("e", 0.0)]], words) == "the"


def test_corrections_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    known = sorted({"".join(rng.choice(list("abcé"), rng.integers(1, 10))) for _ in range(60)})
    asked = sorted({"".join(rng.choice(list("abcé"), rng.integers(1, 10))) for _ in range(40)})

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {w: min((far(w, k), -len(k), k) for k in known) for w in asked}
    got = spelling.corrections(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(k, len(k)) for k in known], "word string, n int")).collect()
    assert {r.word: (r.distance, r.suggestion) for r in got} == {w: (d, k) for w, (d, _, k) in want.items() if d <= 2}


def test_regions_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 3, k, int(rng.integers(0, 60)), int(rng.integers(0, 60)), int(rng.integers(1, 25)), int(rng.integers(1, 12))) for k in range(90)]
    boxes = spark.createDataFrame(rows, "image long, id long, x long, y long, w long, h long")
    pairs = {(a[0], a[1], b[1]): layout.iou(a[2:], b[2:]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and layout.iou(a[2:], b[2:]) > 0}
    assert {(r.image, r.a, r.b): pytest.approx(r.iou) for r in regions.overlaps(boxes).collect()} == pairs
    for image in range(3):
        own = sorted((r for r in rows if r[0] == image), key=lambda r: r[1])
        kept = layout.nms([r[2:] for r in own], 0.3)
        assert sorted(r[2:] for r in rows if (r[0], r[1]) in {(x.image, x.id) for x in regions.suppressed(boxes, 0.3).collect()} and r[0] == image) == sorted(kept)
        dense = layout.dense([r[2:] for r in own], 2)
        assert sorted(r[2:] for r in own if (image, r[1]) in {(x.image, x.id) for x in regions.neighbour_counts(boxes).where("neighbours >= 2").collect()}) == sorted(dense)


def test_clusters(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = neighbours.means(vectors, 5, 5)
    assert got.count() == vectors.where("embedding is not null").count() and {r.cluster for r in got.collect()} <= set(range(5))
    chosen = neighbours.label_medoids(vectors, 2).groupBy("label").count()
    assert chosen.where("count > 2").count() == 0
    x = np.array([[0.0], [1.0], [2.0], [10.0], [11.0], [12.0]])
    assert glyphs.medoids(x, 2).tolist() == [1, 4]
