"""Wrappers and parts of articles whose names hold a word of what is dropped."""

import pytest

from loomstat.llm import htmltext

KEPT = ["has-sidebar", "with-sidebar", "no-header", "search-results", "post-header", "related-work", "legal-text", "side-by-side"]


@pytest.mark.parametrize("name", KEPT)
def test_names_that_only_hold_a_word(name):
    assert htmltext.main_text(f"<div class='{name}'><article><p>body</p></article></div>") == "body"
    assert htmltext.main_text(f"<article><div class='{name}'><h1>title</h1></div><p>body</p></article>") == "title\nbody"
    assert htmltext.main_text(f"<div class='{name}'><p>body of the page</p></div>") == "body of the page"


def test_wrapper_of_the_article_is_kept_and_others_are_dropped():
    assert htmltext.main_text("<div id='search'><p>menu</p><main><p>a</p><div class='comments'>c</div></main></div>") == "a"
    assert htmltext.main_text("<aside><article><p>teaser</p></article></aside><article><p>a</p></article>") == "a"
    for name in ("ad", "comment-list", "site-footer", "cookie-banner", "related-posts", "ad-slot-3"):
        assert htmltext.main_text(f"<article><p>a</p><div class='x {name}'>no</div></article>") == "a"
