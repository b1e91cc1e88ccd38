"""Pages whose outer elements or headings have words of asides keep their text."""

from __future__ import annotations

import pytest

from wirespan.llm.html_text import main_text, merged, parse, wrapper_of

OWN = "Words of page {0}, and of page {0} alone, that are its article and go on for a while."


def texts(pages: list[str]) -> list[str]:
    wrapper = None
    for page in pages:
        own = wrapper_of(parse(page))
        wrapper = own if wrapper is None else merged(wrapper, own)
    return [main_text(parse(page), wrapper) for page in pages]


OUTER = [
    '<div class="layout no-sidebar"><article><p>{}</p></article></div>',
    '<div class="post has-comments"><p>{}</p></div>',
    "<form id=aspnetForm><nav>Menu</nav><div><p>{}</p></div></form>",
    "<form id=aspnetForm><div class=sidebar>Other things</div><article><p>{}</p></article></form>",
    '<main class="ad-free"><p>{}</p></main>',
    '<div class="promo"><main><p>{}</p></main></div>',
]


@pytest.mark.parametrize("outer", OUTER)
@pytest.mark.parametrize("n", [1, 3, 4, 8])
def test_outer_elements_with_words_of_asides(outer, n):
    own = [OWN.format(i) for i in range(n)]
    assert texts([f"<html><body>{outer.format(t)}</body></html>" for t in own]) == own


@pytest.mark.parametrize("n", [1, 5, 8])
def test_titles_and_shared_texts_of_the_main_part_stay(n):
    own = [OWN.format(i) for i in range(n)]
    pages = [f'<body><nav>Home</nav><article><header class="entry-header"><h1>Daily news</h1></header><div class=note2>Shared by all</div><p>{t}</p></article><footer>Imprint</footer></body>' for t in own]
    assert texts(pages) == [f"Daily news\nShared by all\n{t}" for t in own]


@pytest.mark.parametrize("aside", ['<div class="comments"><p>{}</p></div>', "<form><p>{}</p></form>", '<div class="sidebar"><div class="content">{}</div></div>', '<div class="site-header">{}</div>', "<aside><article>{}</article></aside>"])
def test_asides_beside_the_main_part_still_go(aside):
    own = [OWN.format(i) for i in range(6)]
    pages = [f"<body>{aside.format('Said by others about ' + str(i))}<article><p>{t}</p></article></body>" for i, t in enumerate(own)]
    assert texts(pages) == own
