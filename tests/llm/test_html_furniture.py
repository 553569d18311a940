"""Furniture inside an article, prose that only looks like it, and pages that are costly to nest."""

import time

import pytest

from tidewatch.llm.html_text import main_text

PROSE = "<p>The harbour was quiet, the boats lay still, and nobody on the quay spoke a word that morning.</p><p>Later, towards noon, the wind rose, the flags stood out, and the ferries came in one by one.</p>"
TEXT = "The harbour was quiet, the boats lay still, and nobody on the quay spoke a word that morning.\n\nLater, towards noon, the wind rose, the flags stood out, and the ferries came in one by one."


@pytest.mark.parametrize(
    "extra",
    [
        '<p class="ad">Buy a boat now.</p>', '<p>The end.<span class="ad">Buy now.</span></p>', '<div class="sponsored-content"><p>Our partner sells sails.</p></div>', '<div class="notice"><p>This page will move.</p></div>', '<div role="alert">Your session ends.</div>',
        '<div class="cookie-consent"><p>We use cookies, all of them.</p></div>', '<div class="promo-box">Half the price!</div>', '<ul class="share"><li>Send</li><li>Print</li></ul>', '<div class="comment"><p>I was there, it was loud.</p></div>',
        '<div class="reader-comments"><p>First, I say.</p></div>', '<div class="related-posts"><p>More about boats, and about quays.</p></div>', '<ol class="commentlist"><li>Me too.</li></ol>', '<section id="comments"><p>So did I.</p></section>', '<div class="share-buttons">Send this</div>',
        '<div class="site-notice">Moved.</div>', '<div class="article-comments"><p>Fine text.</p></div>', '<div class="google-ad">Sails</div>', '<div id="newsletter-signup">Write to us</div>',
    ],
)
@pytest.mark.parametrize("place", [0, 1])
def test_furniture_goes(extra, place):
    inner = extra + PROSE if place == 0 else PROSE + extra
    want = TEXT if "The end." not in extra else ("The end.\n\n" + TEXT if place == 0 else TEXT + "\n\nThe end.")
    assert main_text(f"<html><body><nav><a href=x>Home</a></nav><article>{inner}</article><footer>All rights</footer></body></html>") == want


@pytest.mark.parametrize(
    ("extra", "text"),
    [
        ('<h2 id="related-work">Related work</h2>', "Related work"), ('<section class="discussion"><p>We discuss it.</p></section>', "We discuss it."), ('<p id="share-price">The share fell.</p>', "The share fell."), ('<section id="share-price"><p>It fell, again.</p></section>', "It fell, again."),
        ('<p class="notice-period">Three months.</p>', "Three months."), ('<section id="notice-period"><p>Three months, at least.</p></section>', "Three months, at least."), ('<section id="related-work"><p>Others did so, before.</p></section>', "Others did so, before."),
        ('<div class="advance"><p>They came closer, slowly.</p></div>', "They came closer, slowly."), ('<section id="social-media"><p>It spread, fast.</p></section>', "It spread, fast."),
    ],
)
def test_prose_stays(extra, text):
    assert main_text(f"<html><body><article>{PROSE}{extra}</article></body></html>") == f"{TEXT}\n\n{text}"


def test_own_header_of_an_article():
    page = f"<html><body><header><p>The site's own claim, big and bold.</p></header><article><header><h1>Boats</h1><p>A standfirst, short.</p><nav>Home</nav><a href=x>By me</a></header>{PROSE}</article></body></html>"
    assert main_text(page) == "Boats\n\nA standfirst, short.\n\n" + TEXT


@pytest.mark.parametrize(
    "filler",
    ["<form>x</form>" * 40_000, "<i>" * 30_000 + "</b>" * 30_000, "<b><div>" + "<i>" * 30_000 + "</b>" * 30_000, "</ " * 60_000, "<header>" * 30_000, "<p>" * 60_000, "<td><table>" * 20_000 + "</td>" * 20_000, "<!-- " * 60_000, "<a " * 60_000],
    ids=range(9),
)
def test_cost_grows_with_length(filler):
    began = time.process_time()
    main_text(f"<html><body><article>{PROSE}{filler}</article></body></html>")
    assert time.process_time() - began < 5
