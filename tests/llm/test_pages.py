"""Extraction on pages whose names mislead, and on broken markup of any length."""

import time

import pytest

from runlens.llm import extraction

PARAGRAPH = "The first long paragraph of this story says what happened on that day in the small town by the river, and why. " * 3
WORDS = " ".join(PARAGRAPH.split())

WRAPPERS = [
    "<div class='layout has-sidebar'><p>{}</p></div>",
    "<div class='post no-comments'><p>{}</p></div>",
    "<section id='related-work'><p>{}</p></section>",
    "<div class='md:block hidden lg:flex'><p>{}</p></div>",
    "<article title='the hidden cost'><p>{}</p></article>",
    "<div class='page-with-sidebar sidebar'><div class='menu'><p>{}</p></div></div>",
    "<body class='banner'><div id=notice><p>{}</p>",
    "<div data-hidden='x' class='search-results'><p>{}</p></div>",
    "<p>{}<!-- never closed",
]


@pytest.mark.parametrize("page", WRAPPERS)
def test_wrappers_keep_their_content(page):
    assert extraction.main_text(page.format(PARAGRAPH), {}) == WORDS


@pytest.mark.parametrize(
    "part",
    [
        "<div class='sidebar'>other words</div>", "<div id=comment-list>other words</div>", "<ul class='site-menu left'><li>other words</ul>",
        "<div hidden>other words</div>", "<div style='color:red; display: none'>other words</div>", "<span aria-hidden=true>other words</span>",
        "<nav>other words</nav>", "<form>other words</form>", "<section class=comments><article>other words</article></section>",
        "<script>other words</script>", "<style>other words",
    ],
)
def test_parts_set_apart(part):
    page = f"<div><p>{PARAGRAPH}</p>{part}"
    assert extraction.main_text(page if part.startswith("<style") else f"{page}<p>{PARAGRAPH}</p></div>", {}).replace(WORDS, "").strip() == ""


@pytest.mark.parametrize("word, apart", [("sidebar", True), ("left-sidebar", True), ("comment_list", True), ("has-sidebar", False), ("no_ads", False), ("related-work", False), ("adds", False), ("ad-3", True), ("-", False)])
def test_names(word, apart):
    assert extraction._is_name(word) is apart


BROKEN = {
    "tags without an end": "<a " * 350_000,
    "unclosed inline": "<b>" * 330_000,
    "unmatched closing": "</b>" * 250_000,
    "paragraphs under inline": "<p><div>" + "<b>" * 100_000 + "<p>x" * 100_000,
    "quotes never closed": '<a "' * 200_001 + ">",
    "cells": "<td><b>x" * 100_000,
    "brackets": "<" * 1_000_000,
    "scripts without an end": "<script " * 120_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_is_linear(name):
    """A megabyte takes no more than some ten times a tenth of it."""
    source = BROKEN[name]
    extraction.main_text(source[: len(source) // 10], {})
    start = time.process_time()
    extraction.main_text(source[: len(source) // 10], {})
    middle = time.process_time()
    extraction.main_text(source, {})
    assert time.process_time() - middle < 30 * (middle - start) + 0.5


def test_text_after_a_tag_that_never_ends():
    assert extraction.main_text(f"<p>{PARAGRAPH}</p><a href='x", {}).startswith(WORDS)
    assert WORDS in extraction.main_text(f"<a title=\"x <p>{PARAGRAPH}</p>", {})
