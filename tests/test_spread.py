"""Work in Python on short rows is dealt out, however few files and tasks a table is read by."""

import pytest

from siltstone.operators import extract
from siltstone.operators.parsers import legacy
from siltstone.plans import catalogue
from siltstone.sources import packages

MADE = ["pdf_text", "xls_text", "pdf_packed", "markdown_counts", "rtf_strip", "image_headers", "mp3_tags", "png_texts", "pdf_streams", "ole_printable_runs", "ppt_text", "ole_detected", "sink_yaml", "exif_gps", "json_parsed"]


@pytest.mark.parametrize("name", MADE)
def test_rows_are_dealt_out(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).rdd.getNumPartitions() >= extract.TASKS


def test_spread_is_even_and_whole(spark):
    rows = spark.range(0, 4800, 1, 1)
    sizes = extract.spread(rows).rdd.glom().map(len).collect()
    assert sum(sizes) == 4800 and max(sizes) <= 2 * 4800 / extract.TASKS
    assert extract.spread(rows).distinct().count() == 4800


def test_zeros_behind_a_workbook_cost_nothing(monkeypatch):
    """A stream filled with zeros gives the cells of the one that ends with its last record, and no record for the zeros."""
    book = legacy.ole_streams(packages.xls("S", [["a", 1, 2.5, True], ["b", "c"]]))["Workbook"]
    bare, read = book.rstrip(b"\0"), []

    class Counted:
        error = legacy.struct.error

        def __getattr__(self, name):
            read.append(name)
            return getattr(__import__("struct"), name)

    monkeypatch.setattr(legacy, "struct", Counted())
    found = []
    for stream in (bare + bytes(-len(bare) % 4 + 4), bare + bytes(400_000)):
        monkeypatch.setattr(legacy, "ole_streams", lambda _, s=stream: {"Workbook": s})
        read.clear()
        found.append((legacy.xls_sheets(b""), len(read)))
    assert found[0] == found[1] and found[0][0][0][1][0][0] == "a"
