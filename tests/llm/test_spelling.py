"""Spelling variants against all pairs of words, and their odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow.dataset as ds

from wirespan.llm import spelling

SF = "/root/testdata/sf0.001"


def naive_counts(docs) -> dict[str, int]:
    n: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive(docs) -> set[tuple]:
    n = naive_counts(docs)
    by_length: dict[int, list] = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    around = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if near(w, v)] for w in n}
    form = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def rows(df) -> set[tuple]:
    found = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_whole_table(spark):
    table = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    wanted = naive(zip(table["doc_id"], table["text"], strict=True))
    assert rows(spelling.op13_spelling(spark, SF)) == wanted and len(wanted) > 100


def test_many_variants(spark):
    rng = random.Random(5)
    base = ["ananas", "aaaaaaa", "züricher", "connection", "×multiply", "ABCDEFgh"]
    words = []
    for _ in range(3000):
        w = rng.choice(base)
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]))
        words.append(w)
    docs = [(i % 70 if i % 9 else None, " ".join(words[i : i + 50]) + rng.choice(["", "Ж中", "? !"])) for i in range(0, len(words), 25)]
    docs += [(-1, None), (-2, ""), (3, "12 -- ."), *docs[:7]]
    wanted = naive(docs)
    assert rows(spelling.group_spellings(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, n int, word string").repartition(5))) == wanted
    assert any(t[1] != t[2] and t[1] for t in wanted) and any(t[1] is None and t[4] for t in wanted)


def test_long_runs(spark):
    a = "abcdefghij" * 3000
    docs = list(enumerate([" ".join([a] * 25), " ".join([a[:-1]] * 5), " ".join([a[:7] + "z" + a[8:]] * 5)]))
    wanted = naive(docs)
    assert rows(spelling.group_spellings(spark.createDataFrame(docs, "doc_id bigint, text string"))) == wanted
    assert {len(t[0]) for t in wanted} >= {30000, 29999}


def test_slices_cut_no_run(monkeypatch):
    text = "ab, cdefgh - ijklmnop \n\u00ff\u0416 qrstuvwxyz abc" * 5
    for size in (1, 3, 10, 1000):
        monkeypatch.setattr(spelling, "SLICE_CHARS", size)
        found = list(spelling.parts(text))
        assert "".join(found) == text and [w for p in found for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == re.findall("[A-Za-zÀ-ÿ]+", text)
    assert list(spelling.parts("")) == []


def test_colliding_hashes_count_nothing(spark):
    words = [(w, 10 * k + 5) for k, w in enumerate(("abcdef", "abcdeg", "abcdefg", "uvwxyz", "uvwxy", "qqqqqqq"))]
    for bits in (64, 3, 1):
        found = spelling.near_words(spark.createDataFrame(words, "word string, n bigint"), bits)
        assert {r.word: (r.n_near, r.best.word) for r in found.collect()} == {"abcdef": (2, "abcdefg"), "abcdeg": (2, "abcdefg"), "abcdefg": (2, "abcdeg"), "uvwxyz": (1, "uvwxy"), "uvwxy": (1, "uvwxyz")}


def test_no_words(spark):
    for docs in ([], [(1, None), (2, "short words only")]):
        assert rows(spelling.group_spellings(spark.createDataFrame(docs, "doc_id bigint, text string"))) == set()
