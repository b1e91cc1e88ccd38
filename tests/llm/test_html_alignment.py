"""Pages in page order against a pattern: alignment against brute force, any order of pages, slots of plain elements."""

from __future__ import annotations

import functools
import itertools
import json
import random

import pytest

from wirespan.llm import html_text
from wirespan.llm.html_text import absorb, align, children_of, in_order, main_text, merged, parse, pattern_of, whole_hash


def wrapper_of_pages(pages: list[str], pattern: int = 0) -> dict:
    wrapper = pattern_of(parse(pages[pattern]))
    for page in pages:
        absorb(wrapper, parse(page))
    return wrapper


def texts(pages: list[str], pattern: int = 0) -> list[str]:
    wrapper = wrapper_of_pages(pages, pattern)
    return [main_text(parse(page), wrapper) for page in pages]


def occurrences(keys: list) -> list:
    return [(k, keys[:i].count(k)) for i, k in enumerate(keys)]


def longest(first: list, second: list) -> int:
    """The most pairs of same occurrences that can be kept in order, by trying all sets of them."""
    other = occurrences(second)
    places = [other.index(o) for o in occurrences(first) if o[0] is not None and o in other]
    return max(n for n in range(len(places) + 1) for some in itertools.combinations(places, n) if list(some) == sorted(some))


def test_chains_against_all_sets():
    rng = random.Random(3)
    for _ in range(400):
        first, second = ([rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 8))] for _ in range(2))
        got = in_order(first, second)
        assert len(got) == longest(first, second)
        assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(got))
        assert all(occurrences(first)[i] == occurrences(second)[j] for i, j in got)


def element(rng):
    return f"<{(tag := rng.choice(['div', 'section']))}>{rng.choice(['', 'Menu', 'Imprint', f'own {rng.random()}'])}</{tag}>"


def test_alignments_of_small_streams():
    """In order, like with like, equal streams one to one, as many whole texts met as can be, and no more to be matched in a gap."""
    rng = random.Random(5)
    for _ in range(400):
        children, slots = (parse("".join(element(rng) for _ in range(rng.randint(0, 7)))) for _ in range(2))
        children, slots = children_of(children), pattern_of(slots)["s"]
        got = align(children, slots)
        pairs = [(i, at) for i, (at, has) in enumerate(got) if has]
        assert all(j < m for (_, j), (_, m) in itertools.pairwise(pairs))
        assert all(children[i].label == slots[j]["l"] for i, j in pairs)
        if [c.label for c in children] == [s["l"] for s in slots]:
            assert pairs == [(i, i) for i in range(len(children))]
        else:
            key = lambda label, whole: (label, whole) if whole else None
            strong = longest([key(c.label, whole_hash(c)) for c in children], [key(s["l"], s["d"]) for s in slots])
            assert sum(bool(slots[j]["d"]) and whole_hash(children[i]) == slots[j]["d"] for i, j in pairs) >= strong
        for (i, j), (k, m) in itertools.pairwise([(-1, -1), *pairs, (len(children), len(slots))]):
            assert all(got[x] == (j + 1, False) for x in range(i + 1, k))
            assert not {c.label for c in children[i + 1 : k]} & {s["l"] for s in slots[j + 1 : m]}


def page(i: int, blocks: int, rng) -> str:
    body = "".join(f"<div>Part {k} of page {i} tells {rng.random()}</div>" for k in range(blocks))
    extra = "<section><ul><li>more</li></ul></section>" * rng.randint(0, 2)
    return f"<body><div>Start Contact Us</div>{body}{extra}<div>Made by us</div></body>"


def test_wrappers_add_up_in_any_order():
    rng = random.Random(9)
    pages = [page(i, rng.randint(0, 4), rng) for i in range(15)]
    whole = wrapper_of_pages(pages)
    assert whole["n"] == 15 and sum(s["n"] for s in whole["s"]) + sum(g["n"] for g in whole["g"].values()) > 30
    blank = pattern_of(parse(pages[0]))
    assert merged(blank, whole) == merged(whole, blank) == whole
    for cuts in ([5, 10], [1, 14], [7, 7]):
        rng.shuffle(pages)
        shares = [pages[a:b] for a, b in itertools.pairwise([0, *cuts, 15])]
        partial = []
        for share in shares:
            own = json.loads(json.dumps(blank))
            for p in share:
                absorb(own, parse(p))
            partial.append(own)
        rng.shuffle(partial)
        assert functools.reduce(merged, partial) == whole


def test_optional_and_repeated_groups():
    own = lambda i: f"<h1>Title {i}</h1>"
    pages = [f"<body><div>{own(i)}</div>{'<section>x</section>' * i}</body>" for i in range(3)]
    wrapper = wrapper_of_pages(pages)
    assert [s["l"] for s in wrapper["s"]] == ["div"] and wrapper["s"][0]["n"] == 3
    (group,) = wrapper["g"].values()
    assert (group["l"], group["n"], group["q"]) == ("section", 2, "+")


@pytest.mark.parametrize("n", [2, 3, 4, 40])
def test_plain_elements_are_told_apart_by_their_place(n):
    own = [f"Article {i} says what only article {i} says, in some more words. " * 3 for i in range(n)]
    pages = [f"<body><div>Start Contact Us</div><div>{t}</div><div>Made by us since 1990</div></body>" for t in own]
    for pattern in (0, n - 1):
        assert texts(pages, pattern) == [t.strip() for t in own]


@pytest.mark.parametrize("n", [4, 12])
def test_plain_elements_beside_any_number_of_blocks(n):
    own = [[f"Part {k} of article {i}, which no other article has in it." for k in range(1 + i % 4)] for i in range(n)]
    pages = ["<body><div>Start Contact Us</div>" + "".join(f"<div>{t}</div>" for t in parts) + "<div>Made by us since 1990</div></body>" for parts in own]
    for pattern in range(4):
        assert texts(pages, pattern) == ["\n".join(parts) for parts in own]


def test_copies_on_a_host_keep_what_only_they_have():
    """Five pages of forty are copies of an article that is longer than the others: no part of it is template."""
    long = "".join(f"<div>Part {k} of the article that was copied.</div>" for k in range(9))
    bodies = [long] * 5 + [f"<div>Article {i} says its own.</div><div>And says {i} more.</div>" for i in range(35)]
    pages = [f"<body><div>Start Contact Us</div>{b}<div>Made by us</div></body>" for b in bodies]
    for pattern in (0, 20):
        got = texts(pages, pattern)
        assert got[0] == "\n".join(f"Part {k} of the article that was copied." for k in range(9))
        assert got[10] == "Article 5 says its own.\nAnd says 5 more."


def test_partitions_and_copies_of_the_pattern_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, "http://plain.org/", page(i % 20, 1 + i % 3, rng)) for i in range(40)]
    rows += [(100 + i, "http://plain.org/", rows[i % 3][2]) for i in range(30)] + [(200, None, None), (201, "http://plain.org/x", ""), (None, "http://plain.org/x", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [sorted(((r.page_id or -1, r.url or "", r.text) for r in html_text.extract(pages.repartition(n)).collect())) for n in (1, 13)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all("Start Contact" not in t and "Made by" not in t for i, _, t in got[0])
    assert sum(t == "" for _, _, t in got[0]) == 2
