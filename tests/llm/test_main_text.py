"""Main text of all pages of the small tables against a second, slow reading of them, with and without the tags that name sections."""

import re
from html.parser import HTMLParser

import pandas as pd
import pytest

from siltstone.llm import mainhtml

SECTIONS = "article|main|nav|footer|header|aside|section|form|menu|dialog"


class Article(HTMLParser):
    """The text of an article element, a block for each of its block elements; the tables' articles hold headings, paragraphs and line breaks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("article", "h1", "h2", "p", "ul", "li", "table", "tr", "td", "div", "pre"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.depth -= 1
        if tag in ("article", "h1", "h2", "p", "ul", "li", "table", "tr", "td", "div", "pre"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def article(html: str) -> str:
    p = Article()
    p.feed(html)
    p.close()
    return "\n\n".join(t for t in (" ".join(b.split()) for b in p.blocks) if t)


def neutral(html: str) -> str:
    """Tags that name sections become div, and no element has a class, id or role."""
    html = re.sub(rf"<(/?)(?:{SECTIONS})\b[^>]*>", r"<\1div>", html)
    return re.sub(r"<(?!a\b)([a-zA-Z0-9]+)\s[^>]*>", r"<\1>", html)


def slow_labels(first: list[int], found: list[mainhtml.Block]) -> list[int]:
    """The second pass, block by block over all others."""
    if 1 not in first:
        return [int(x != 0) for x in first]

    def walk(a, b):
        return sum(1 + mainhtml.FAR * ((found[k].section != found[k + 1].section) + (found[k + 1].heading or mainhtml.colophon(found[k + 1]))) for k in range(a, b))

    out = []
    for i, label in enumerate(first):
        if label < 0:
            sides = []
            for side in (range(i - 1, -1, -1), range(i + 1, len(first))):
                j = next((j for j in side if first[j] >= 0), None)
                if j is not None:
                    sides.append((walk(min(i, j), max(i, j)), -first[j]))
            label = -min(sides)[1]
        out.append(label)
    return out


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html.tolist()


def test_pages_of_the_tables(spark, sf, pages):
    assert [mainhtml.main_text(h) for h in pages] == [article(h) for h in pages]
    for r, h in zip(mainhtml.extract(spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id")).collect(), pd.read_parquet(f"{sf}/pages.parquet").sort_values("page_id").html):
        assert r.text == article(h) and r.n_chars == len(r.text) > 0


def test_passes_decide_without_names(pages):
    """No article, main, nav or footer element, no class, id or role: density, length, links and neighbours alone."""
    right = sum(mainhtml.main_text(neutral(h)) == article(h) for h in pages)
    assert right >= 0.95 * len(pages), right


def test_second_pass_is_brute_force(pages):
    mixed = 0
    for h in pages + [neutral(h) for h in pages]:
        title, found = mainhtml.blocks(h)
        first = mainhtml.first_pass(title, found)
        mixed += -1 in first and 1 in first
        assert mainhtml.second_pass(first, found) == slow_labels(first, found)
    assert mixed > 100  # open blocks occur


PROSE = "This is a long sentence of the kind that is found in the text of an article and it has many of the words that stop. " * 3


def test_evidence_of_names():
    outside = f"<div>{PROSE}</div>"
    assert mainhtml.main_text(f"<body>{outside}<article><p>Short.</p><p><a href=x>a link that is a paragraph</a></p></article>{outside}</body>") == "Short.\n\na link that is a paragraph"
    assert mainhtml.main_text(f"<div class='notice'>{PROSE}</div><div>{PROSE}</div><div class=comments><p>{PROSE}</p></div>") == PROSE.strip()
    assert mainhtml.main_text(f"<div class='widget'><p>{PROSE}</p><p>And more.</p></div>") == PROSE.strip() + "\n\nAnd more."  # a class alone doesn't hide all
    assert mainhtml.main_text(f"<title>The news</title><a href=x>Menu</a><p>A short word of ours.</p><h1>The news</h1><p>{PROSE}</p><p>© 2020 nobody</p>") == f"The news\n\n{PROSE.strip()}"


def test_long_page_and_clashing_columns(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "<div>" * 3000 + "end" + "</article>"
    rows = [(1, "u", long, "x", 7), (2, None, None, None, None)]
    got = {r.page_id: r for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()}
    assert got[1].text == "\n\n".join([PROSE.strip()] * 5000 + ["end"]) and got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars) == ("", 0)
