"""What is inserted into an article goes by its whole name; sections of the article stay."""

import pytest

from ravelin.llm import html_extraction

PAGE = (
    "<html><body><nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>First paragraph of the article, with enough words to count.</p>"
    '<section {}><p>The middle part of the text, a paragraph of plain prose.</p></section>'
    "<p>Last paragraph of the article, with enough words to count.</p></article><footer>imprint</footer></body></html>"
)


@pytest.mark.parametrize("name", ['class="related-work"', 'id="sharing"', 'class="ad-hoc-methods"', 'class="commentary"', 'class="shared-memory related-work"', 'id="promotion"'])
def test_sections_stay(name):
    assert "middle part" in html_extraction.extract(PAGE.format(name), html_extraction.Weights({}, {}))


@pytest.mark.parametrize("name", ['id="comments"', 'class="related-posts"', 'class="wide ad-banner"', 'class="reader-comments"', 'class="newsletter_signup"', 'class="share"'])
def test_insertions_go(name):
    text = html_extraction.extract(PAGE.format(name), html_extraction.Weights({}, {}))
    assert "middle part" not in text and "First paragraph" in text and "Last paragraph" in text
