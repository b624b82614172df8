"""Cases of extraction by hand: condemned runs, headlines beside the text, names of things that are no article."""

import pytest

from weirflow.llm.html_extract import extract, names_noise

LONG = "A sentence of the article that is long enough to weigh more than what stands around it, and then some more words."


def page(body):
    return f"<html><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f'<article><p><span class="share">Tweet</span> The real sentence.</p><p>{LONG}</p></article>', f"The real sentence.\n\n{LONG}"),
        (f'<article><p><a class="tags" href="#">Tag</a>: first words of it.</p><p>{LONG}</p></article>', f": first words of it.\n\n{LONG}"),
        (f'<article><p>Real text <span class="ad">BUY NOW</span> goes on</p><p>{LONG}</p></article>', f"Real text goes on\n\n{LONG}"),
        (f'<article><h2 id="search">Search</h2><p id="comments">On comments.</p><p>{LONG}</p></article>', f"Search\n\nOn comments.\n\n{LONG}"),
        (f'<article><p>{LONG}</p><div id="comments"><p>First!</p></div></article>', LONG),
        (f"<main><h1>Headline</h1><article><p>{LONG}</p></article></main>", f"Headline\n\n{LONG}"),
        (f'<div class="wrap"><h1>Headline</h1><div class="content"><p>{LONG}</p><p>{LONG}</p></div></div>', f"Headline\n\n{LONG}\n\n{LONG}"),
        (f'<h1>Site</h1><div class="content"><p>{LONG}</p></div>', LONG),
        (f'<div class="wrap"><div class="content"><p>{LONG}</p></div><h1>Later</h1></div>', LONG),
        (f"<article><p>Press <button><div>Click</div></button> here.</p><p>{LONG}</p></article>", f"Press here.\n\n{LONG}"),
        (f"<article><p>See <menu><li>One</li><li>Two</li></menu> it.</p><p>{LONG}</p></article>", f"See it.\n\n{LONG}"),
    ],
)
def test_runs_and_headlines(body, want):
    got = extract(page(body), None)
    if "<menu>" in body:
        assert "One" not in got and "Two" not in got and LONG in got
    else:
        assert got == want


@pytest.mark.parametrize("name", "social-share newsletter-signup navbar-default google-ads author-box advertisement-label sidebar site-footer share-buttons related-posts cookie-consent socialShare".split())
def test_names_of_noise(name):
    assert names_noise([name])


@pytest.mark.parametrize("name", "author content has-sidebar share-price related-work article-body post entry-title tagline addendum socialism header-image search-theory".split())
def test_names_of_text(name):
    assert not names_noise([name])
