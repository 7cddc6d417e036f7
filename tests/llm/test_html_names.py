"""Names that leave a block out, names of stories, and markup that nothing closes."""

import time

import pytest

from tidewatch.llm.html_extraction import main_text

STORY = "<p>The story itself, of some length to be read.</p>"


@pytest.mark.parametrize("name", ["comment-body", "comment-content", "sidebar-content", "cookie-text", "ad-text", "related-content", "newsletter-body", "notice-body", "footer-main", "related-post", "sponsored-article", "comments"])
def test_blocks_left_out_by_name(name):
    page = f"<body><article>{STORY}<div class='{name}'><p>Words that are none of the story, at some length too.</p></div></article></body>"
    assert main_text(page) == "The story itself, of some length to be read."


@pytest.mark.parametrize("name", ["search-story", "menu-article", "cookie-story", "story", "post-body", "content-main"])
def test_names_of_stories(name):
    assert main_text(f"<body><nav>Menu</nav><div class='{name}'>{STORY}</div></body>") == "The story itself, of some length to be read."


@pytest.mark.parametrize("junk", ["<a ", "<!--", "<!-- > ", "</b", "<?x "])
def test_markup_that_nothing_closes_takes_no_time(junk):
    began = time.time()
    main_text(f"<body><article>{STORY}</article>" + junk * (80_000 // len(junk)))
    assert time.time() - began < 2


@pytest.mark.parametrize("tail", ["<b class=x", "</b", "<!-- x", "<b x <c y", "<", "<?x", "< b", "a & b", "<!-- a > b <!-- c", "<!-- a --> b"])
def test_unclosed_markup_is_text(tail):
    want = {"<!-- a --> b": "b"}.get(tail, tail)
    assert main_text(f"<p>hi {tail}") == f"hi {want}".strip()
