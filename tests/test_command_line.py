"""The command line over a few files."""

import json

import pytest

from siltstone.__main__ import main


@pytest.fixture
def files(tmp_path):
    for name, body in (("b.json", '{"k": "v"}'), ("a.txt", "plain words\nof two lines"), ("c.html", "<html><head><title>T</title></head><body>x</body></html>"), ("bad.json", '{"k": [}')):
        (tmp_path / name).write_text(body)
    return tmp_path


def test_order_and_forms(spark, files, tmp_path, capsys):
    names = [str(files / n) for n in ("c.html", "b.json", "a.txt")]
    out = tmp_path / "out.jsonl"
    assert main([*names, "--format", "json", "--output", str(out)], spark) == 0
    rows = [json.loads(x) for x in out.read_text().splitlines()]
    assert [r["mime_type"] for r in rows] == ["text/html", "application/json", "text/plain"] and rows[1]["content"] == "k: v"
    assert main([names[2], names[0], names[2], "-d"], spark) == 0
    said = capsys.readouterr().out
    assert said.count("File: ") == 3 and said.index("text/plain") < said.index("text/html") < said.rindex("text/plain")
    assert main([names[1], "-m", "-f", "yaml"], spark) == 0
    assert "content" not in capsys.readouterr().out


def test_errors(spark, files, capsys):
    good, bad, none = (str(files / n) for n in ("a.txt", "bad.json", "none.txt"))
    assert main([good, bad, none, "-v"], spark) == 0
    both = capsys.readouterr()
    assert "plain words" in both.out and f"Error processing {bad}" in both.err and f"Error processing {none}: not found" in both.err and "1 succeeded, 2 failed" in both.err
    assert main([bad], spark) == 1 and main([none], spark) == 1
