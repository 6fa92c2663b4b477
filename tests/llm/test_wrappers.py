"""Layout wrappers whose class or id holds a sign of what isn't main text."""

import pytest

from siltstone.llm import mainhtml


@pytest.mark.parametrize("wrapper", ['class="layout with-sidebar"', 'id="no-sidebar"', 'class="hasSidebar"'])
@pytest.mark.parametrize("name", ["article", "main"])
def test_wrapper_of_an_article(wrapper, name):
    page = f"<body><div {wrapper}><p>Outside.</p><{name}><p>The text.</p><div class='share-bar'>Share</div></{name}></div></body>"
    assert mainhtml.main_text(page) == "The text."


def test_what_stays_hidden():
    page = "<body><article><p>The text.</p></article><div class='related-posts'><article><p>Teaser.</p></article></div></body>"
    assert mainhtml.main_text(page) == "The text."
    assert mainhtml.main_text("<div class='sidebar'><article><p>Teaser.</p></article></div>") == ""
    assert mainhtml.main_text("<div class='with-sidebar'><article class='comment'><p>A comment.</p></article></div>") == ""
    assert mainhtml.main_text("<div class='with-sidebar' hidden><article><p>Not shown.</p></article></div>") == ""
