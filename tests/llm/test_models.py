"""Language ID, language-model scores, fingerprints, page texts and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wirespan.llm import elias_fano, fingerprint, html_text, language_id, lm_scoring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_language_held_out_accuracy(spark, texts):
    got = {r.doc_id: r for r in language_id.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0 and d.lang and got[d.doc_id].lang_pred != "und"]
    assert len(got) == len(docs) and all(got[d.doc_id].held_out for d in held)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.95


def test_code_lengths_against_a_naive_coder():
    """Prediction by partial matching step by step: escapes down the orders, counts as they were after training."""
    samples = {"en": [b" the cat sat on the mat ", b" a dog "], "fr": [b" le chat est la ", b" un chien et le chat "]}
    contexts = {}
    for language, texts in samples.items():
        tree = contexts[language] = {}
        for text in texts:
            data = b"\0\0\0" + text
            for i in range(3, len(data)):
                for k in range(4):
                    tree.setdefault(data[i - k : i], Counter())[data[i]] += 1

    def bits(language, text):
        total, data = 0.0, b"\0\0\0" + text
        for i in range(3, len(data)):
            for k in range(3, -1, -1):
                seen = contexts[language].get(data[i - k : i])
                if not seen:
                    continue
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / (seen.total() + len(seen)))
                    break
                total -= math.log2(len(seen) / (seen.total() + len(seen)))
            else:
                total += 8.0
        return total

    texts = [b" the dog ", b" le chien ", b" zzz qqq ", b" a ", b" chat the la mat xat "]
    got = language_id.Models(samples).bits(texts)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, [bits("en", text), bits("fr", text)])


def test_language_of_repeated_and_tied_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "the cat and the dog", "fr"), (2, "the cat and the dog", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(got) == 4 and {(r.lang_pred, r.score) for r in got} == {("en", 0.5)}


def test_language_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", 0.5), (2, "le chat est sur la table et le chien", "fr", 0.1), (3, None, "en", 0.0), (4, "12 34 !!", "fr", 0.0), (5, "the dog and the mat", None, 0.0), (6, "the dog " * 50_000, None, 0.0), (None, "le chien et la table", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    models = language_id.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, models).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "en", 6: "en", None: "fr"}
    assert all(0 <= v[1] <= 1 for v in got.values()) and got[3][1] == 0
    assert language_id.reject_unknown(docs, models).columns == docs.columns
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for top in (5, 1000, 2**40, 2**62):
        values = np.unique(rng.integers(0, top, 3000, dtype=np.uint64))
        ef = elias_fano.EliasFano.of(values)
        assert (ef.get(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
        others = np.setdiff1d(rng.integers(0, top, 3000, dtype=np.uint64), values)
        assert (ef.find(others) == -1).all()


def test_scores_against_brute_force(spark, texts):
    token_lists = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")) if w] + [None] for i, d in texts.items()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter(t for i in train for t in token_lists[i])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_scoring.op6_lm_scoring(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, tokens in token_lists.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(tokens), sum(t in counts for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def naive_scores(token_lists, train, discount=lm_scoring.DISCOUNT):
    """log10 probabilities of texts by back-off from trigrams to bigrams to the base, from counts in dictionaries."""
    uni, bi, tri = Counter(), {}, {}
    for tokens in (token_lists[i] for i in train):
        uni.update(tokens)
        padded = ["<begin>", "<begin>", *tokens]
        for u, v, w in zip(padded, padded[1:], tokens, strict=False):
            bi.setdefault(v, Counter())[w] += 1
            tri.setdefault((u, v), Counter())[w] += 1
    norm = uni.total() + len(uni) + 1

    def p(u, v, w):
        if w in tri.get((u, v), ()):
            return (tri[u, v][w] - discount) / tri[u, v].total()
        left = discount * len(tri[u, v]) / tri[u, v].total() if (u, v) in tri else 1.0
        if w in bi.get(v, ()):
            return left * (bi[v][w] - discount) / bi[v].total()
        return left * (discount * len(bi[v]) / bi[v].total() if v in bi else 1.0) * (uni[w] + 1) / norm

    for tokens in token_lists.values():
        padded = ["<begin>", "<begin>", *tokens]
        yield sum(math.log10(p(u, v, w)) for u, v, w in zip(padded, padded[1:], tokens, strict=False))


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_naive_back_off(spark, texts, monkeypatch, small):
    """Also with many shards, words that are split over several of them, few frequent words and short runs of texts."""
    if small:
        for name, value in (("SHARD_TOKENS", 5000), ("SPLIT", 1 << 10), ("FREQUENT", 300), ("GROUP_TOKENS", 9000), ("SLICE", 20_000)):
            monkeypatch.setattr(lm_scoring, name, value)
    token_lists = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")) if w] + [None] for i, d in texts.items()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    got = {r.doc_id: r for r in lm_scoring.op6_lm_scoring(spark, SF).collect()}
    for (i, tokens), wanted in zip(token_lists.items(), naive_scores(token_lists, train), strict=True):
        assert abs(got[i].score - wanted) <= 0.02 * len(tokens) + 1e-6, i
    close = [abs(got[i].score - wanted) / len(token_lists[i]) for i, wanted in zip(token_lists, naive_scores(token_lists, train), strict=True)]
    assert np.mean(close) < 0.003


def test_trie_against_dictionaries():
    """Random trigrams, some words with all their bigrams given apart, before and after a trip through bytes."""
    rng = np.random.default_rng(5)
    v, u, w = rng.integers(10, 40, 4000).astype(np.uint64) << np.uint64(40), rng.integers(1, 60, 4000).astype(np.uint32), rng.integers(1, 60, 4000).astype(np.uint32)
    n, split = rng.integers(1, 4, 4000), v < np.uint64(15 << 40)
    more = (np.full(3, 11 << 40, np.uint64), np.array([70, 71, 72], np.uint32), np.array([2, 1, 1]))
    whole = lm_scoring.merged_bigrams(*(np.concatenate([x[split], y]) for x, y in zip((v, w, n), more, strict=True)))
    bi, tri = {}, {}
    for a, b, c, k in zip(v.tolist(), u.tolist(), w.tolist(), n.tolist(), strict=True):
        tri.setdefault((a, b), Counter())[c] += k
        bi.setdefault(a, Counter())[c] += k
    for a, c, k in zip(*(x.tolist() for x in more), strict=True):
        bi[a][c] += k
    tops, words = np.unique(np.concatenate([v, whole[0]])), np.unique(np.concatenate([u, w, whole[1]]))
    at = np.searchsorted
    built = elias_fano.Trie.of(tops, words, (at(tops, v), at(words, u), at(words, w), n), (at(tops, whole[0]), at(words, whole[1]), whole[2]), 0.75)
    ask = sorted(zip(rng.integers(8, 42, 3000) << 40, rng.integers(1, 62, 3000), rng.integers(1, 74, 3000), strict=True))
    av, au, aw = np.array([x[0] for x in ask], np.uint64), np.array([x[1] for x in ask], np.uint32), np.array([x[2] for x in ask], np.uint32)
    for trie in (built, elias_fano.Trie.from_buffer(np.frombuffer(built.to_bytes(), np.uint8))):
        first = np.flatnonzero(np.diff(av, prepend=0))
        value, open_ = trie.score(av[first], np.diff(first, append=len(av)), np.arange(100, dtype=np.uint32), au.astype(np.intp), aw.astype(np.intp))
        for (a, b, c), x, o in zip(ask, value.tolist(), open_.tolist(), strict=True):
            a, b, c = int(a), int(b), int(c)
            assert o == (c not in bi.get(a, ()))
            t = tri.get((a, b), Counter())
            if c in t:
                wanted = math.log10((t[c] - 0.75) / t.total())
            else:
                wanted = math.log10(0.75 * len(t) / t.total()) if t else 0.0
                wanted += math.log10((bi[a][c] - 0.75) / bi[a].total()) if not o else math.log10(0.75 * len(bi[a]) / bi[a].total()) if a in bi else 0.0
            assert abs(x - wanted) < 0.05
        assert (trie.seen(np.array([11 << 40, 9 << 40], np.uint64)) == [bi[11 << 40].total(), 0]).all()


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1, "x"), (2, "", 2, "x"), (3, "A a\ta", 3, "x"), (3, "A a\ta", 3, "x"), (None, "é " * 400_000, 4, None)], "doc_id bigint, text string, more int, value string")
    out, total = lm_scoring.score(docs, F.lit(True))
    got = out.collect()
    assert total == 400_011 and out.columns == ["doc_id", "more", "value", "n_tokens", "n_known", "base_score", "score"]
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 400_001, 400_001), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4)]
    untrained, total = lm_scoring.score(docs, F.lit(False))
    assert total == 0 and {(r.n_known, r.score) for r in untrained.collect()} == {(0, 0.0)}
    assert lm_scoring.score(docs.limit(0), F.lit(True))[0].collect() == []


def test_fingerprints_table(spark, texts):
    got = {r.doc_id: r for r in fingerprint.op8_fingerprint(spark, SF).collect()}
    ids = sorted(texts)
    whole = {i: texts[i].text or "" for i in ids}
    likes = []
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        n = len(whole[i])
        edited = whole[i][: n - n // 4] + whole[after][: n // 4]
        own, other, following = fingerprint.fingerprints([whole[i], edited, whole[after]])
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == fingerprint.as_text(np.array([own, other]))
        assert math.isclose(r.near_edited, np.mean(own == other)) and math.isclose(r.near_next, np.mean(own == following))
        likes.append((r.near_edited, r.near_next, whole[i] == whole[after]))
    assert np.mean([a for a, _, _ in likes]) > 0.5 > 0.2 > np.mean([b for _, b, same in likes if not same])
    label = least_of_class(fingerprint.fingerprints([whole[i] for i in ids]))
    assert [got[i].class_id for i in ids] == [ids[k] for k in label]


def least_of_class(prints):
    """The place of the first fingerprint of each one's class, by all pairs."""
    alike = (prints[:, None] == prints[None]).mean(2) >= fingerprint.LIKE
    label = np.arange(len(prints))
    while (new := np.array([label[a].min() for a in alike])).tolist() != label.tolist():
        label = new
    return label


def naive_fingerprint(text):
    """The walk a step at a time, with all hashes of all steps."""
    mixed, base, more, mask = fingerprint.mixed, int(fingerprint.BASE), int(fingerprint.MIX2), 2**64 - 1
    h = lambda x: int(mixed(np.array([x & mask], np.uint64))[0])
    path, i, t = [], 0, 0
    while i < len(text):
        path.append(text[i])
        kind = h(ord(text[i]) * base) & (fingerprint.KINDS - 1)
        i += h((t % fingerprint.STEPS * fingerprint.KINDS + kind + 1) * base) >> 63
        t += 1
    if not path:
        return [0] * fingerprint.SLOTS
    steps = np.arange(1, len(path) + 1, dtype=np.uint64) * np.uint64(base)
    at = [int(np.argmin(mixed(steps + np.uint64(s * more & mask)))) for s in range(fingerprint.SLOTS)]
    return [max(1, h(h(ord(path[k]) * base) + k * more) & 0xFFFF) for k in at]


def test_fingerprints_against_a_naive_walk():
    rng = np.random.default_rng(8)
    some = ["", "a", "ab", "\0", "日本語の文", "a" * 5000, *("".join(rng.choice(list("abc de\n"), n)) for n in [*range(3, 40), 700, 3000])]
    assert fingerprint.fingerprints(some).tolist() == [naive_fingerprint(t) for t in some]


def test_alike_pairs_against_all_pairs(monkeypatch):
    monkeypatch.setattr(fingerprint, "TOGETHER", 50)
    rng, need = np.random.default_rng(5), 52
    origins = rng.integers(0, 12, (40, 64)).astype(np.uint16)
    origins[:, :20] = 1  # slots that all share
    rows = origins[rng.integers(0, 40, 300)]
    for row in rows:
        row[rng.choice(64, rng.integers(0, 18), replace=False)] += 100
    parts = rng.integers(0, 30, 300)
    first, second, a, b = rows[:100], rows, parts[:100], parts
    equal = (first[:, None] == second[None]).sum(2)
    want = {(i, b[j]) for i, j in zip(*np.nonzero(equal >= need), strict=True) if a[i] != b[j]}
    i, j = fingerprint.alike_pairs(first, second, a, b, need)
    assert len(want) > 100 and (equal[i, j] >= need).all() and sorted(want) == sorted(zip(i, b[j], strict=True))
    assert [len(x) for x in fingerprint.alike_pairs(first[:0], second, a[:0], b, need)] == [0, 0]


def test_edited_texts_of_odd_rows(spark):
    kind = "doc_id bigint, text string, next string, blob string, v int"
    long = "a long text " * 250_000
    rows = [(4, "four four"), (None, "none"), (4, "four four"), (2, None), (7, long), (7, ""), (9, "four four"), (11, "日本語の文章です")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], kind)
    table = fingerprint.materialised(fingerprint.compare_edited(docs))
    got = fingerprint.with_class(table).collect()
    order = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars) for r in got) == sorted((i, len(t)) for i, t in order)
    last = hashlib.sha256(("日本語の文章" + "no").encode()).digest()
    assert [r.edited_hash for r in got if r.doc_id == 11] == [last]
    assert {(r.doc_id, r.class_id) for r in got if r.n_chars == 9} == {(4, 4), (9, 4)}
    assert {r.class_id for r in got if r.n_chars == 0} == {2} and {r.class_id for r in got if r.doc_id is None} == {None}
    one = fingerprint.compare_edited(docs.where("doc_id = 11")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(8, 1.0)]
    empty = fingerprint.materialised(fingerprint.compare_edited(docs.limit(0)))
    assert empty.count() == 0 and fingerprint.with_class(empty).count() == 0


def test_similar_fingerprints(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 20
    rows = [(4, text), (2, text[:600] + "X" + text[600:]), (9, text), (7, None), (8, ""), (5, "something else entirely " * 30)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id bigint, text string, hub string")
    assert {r.doc_id: r.class_id for r in fingerprint.similar(docs).collect()} == {2: 2, 4: 2, 9: 2, 7: 7, 8: 7, 5: 5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav><header><h1>Site</h1></header>
<article><h2>Title {i}</h2><p>First &amp; <b>bold</b>  paragraph {i}.</p><ul><li>one {i}</li><li>two</li></ul><div class="ad">Buy</div><p>Last &lt;x&gt; {i}</p></article>
<div class="comments"><p>Reader says {i}</p></div><footer>Imprint</footer></body></html>"""


def test_page_texts(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.replace("{i}", f"n{i}"), "x") for i in range(8)]
    rows += [(20, None, None, "x"), (21, "http://b.org/", "", "x"), (22, "http://c.org/", "<p>Unclosed <b>text", "x"), (23, "http://c.org/2", "<div>" * 500 + "deep" + "</div>" * 500, "x"), (24, "http://d.org", "no markup", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for i in range(8):
        assert got[i] == f"Title n{i}\nFirst & bold paragraph n{i}.\none n{i}\ntwo\nLast <x> n{i}"
    assert [got[i] for i in (20, 21, 22, 24)] == ["", "", "Unclosed text", "no markup"]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_pages_table(spark):
    got = html_text.op7_html_text(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and sum(r.n_chars > 0 for r in got) > 0.9 * len(got)


def test_pipeline_stages(spark, texts):
    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialised(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and now, name
        docs, ids = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids


def test_similar_fingerprints_of_a_shared_beginning(spark):
    """Many documents with one beginning, and near copies among them, against all pairs."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(500)]
    draw = lambda n: " ".join(rng.choice(words, n))
    start, rows = draw(100), []
    for i in range(150):
        text = f"{start} {draw(100)}"
        rows += [(2 * i, text), (2 * i + 1, text[:-40] + draw(6))]
    label = least_of_class(fingerprint.fingerprints([t for _, t in rows]))
    assert 20 < len(set(label.tolist())) < len(rows) - 20
    got = {r.doc_id: r.class_id for r in fingerprint.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label.tolist()


def test_page_texts_that_begin_alike_or_lie_deep(spark):
    begin = "the same words as on every page " * 10
    body = lambda rest: f"<body><article><h1>About {rest}</h1><div class=body>{begin}<br>and then {rest}</div></article></body>"
    rows = [(i, "http://a.org/", body(f"number {i}")) for i in range(6)]
    rows += [(10 + i, "http://b.org/", body("it").replace("About it", f"About {i}")) for i in range(6)]
    rows += [(20, "http://c.org/", "<div>" * 500 + "deep" + "</div>" * 500)]
    rows += [(21, "http://d.org/", "<div><article><p>Before</p>" + "<div>" * 80 + "deep" + "</div>" * 80 + "<p>After</p></article></div>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i].endswith(f"{begin}and then number {i}") and got[10 + i].endswith(f"{begin}and then it")
    assert got[20] == "deep" and got[21] == "Before\ndeep\nAfter"


def random_element(rng, depth=0):
    e = html_text.Element(rng.choice(["div", "section", "p", "ul"]), frozenset(rng.sample(["red", "blue", "menu"], rng.randint(0, 1))))
    for _ in range(rng.randint(0, 4) if depth < 3 else 0):
        e.items.append(random_element(rng, depth + 1) if rng.random() < 0.6 else (rng.choice(["same", "some text", "other"]), rng.random() < 0.2))
    return e


def test_wrappers_merge_in_any_order():
    """Against groups, counts and texts gathered from all pages by the path of labels that leads to them."""
    import functools
    import random

    rng = random.Random(9)
    pages = [random_element(rng) for _ in range(12)]
    for p in pages:
        p.label = "html"
    wrappers = [html_text.wrapper_of(p) for p in pages]
    whole = functools.reduce(html_text.merged, wrappers)
    for _ in range(5):
        rng.shuffle(wrappers)
        cut = rng.randint(1, 11)
        assert html_text.merged(functools.reduce(html_text.merged, wrappers[:cut]), functools.reduce(html_text.merged, wrappers[cut:])) == whole

    def walk(nodes, w):
        """nodes: for each page, its elements that lead here."""
        children = [c for own in nodes for e in own for c in e.items if isinstance(c, html_text.Element)]
        assert w["g"].keys() == {c.label for c in children}
        texts = {html_text.text_hash(e) for own in nodes for e in own}
        assert w["t"] == (texts.pop() if len(texts) == 1 else "") and w["n"] == sum(bool(own) for own in nodes)
        for label, g in w["g"].items():
            here = [[c for e in own for c in e.items if isinstance(c, html_text.Element) and c.label == label] for own in nodes]
            again = any(sum(isinstance(c, html_text.Element) and c.label == label for c in e.items) > 1 for own in nodes for e in own)
            assert g["q"] == "+" if again else True
            walk(here, g)

    walk([[p] for p in pages], whole)


def test_page_texts_of_hosts_without_telling_names(spark):
    """Neither article nor telling class names: what all pages of the host share is no content, which a page alone cannot tell."""
    share = "<div class=qc><div>This paragraph is on every page of the site, word by word.</div></div>"
    page = lambda i: f"<body><div class=qa>Start Products Contact Us Today</div><div class=qb><h1>Title {i}</h1><p>{'Body of page %d. ' % i * 20}</p><p>Shared by all articles.</p></div>{share}<div class=qd>Made by us since 1990</div></body>"
    rows = [(i, f"http://plain.org/{i}", page(i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [{r.page_id: r.text for r in html_text.extract(pages.repartition(n)).collect()} for n in (1, 16)]
    assert got[0] == got[1]
    for i in range(40):
        assert got[0][i] == f"Title {i}\n{' '.join(['Body of page %d.' % i] * 20)}\nShared by all articles."
    alone = html_text.parse(page(3))
    assert html_text.main_text(alone, html_text.wrapper_of(alone)) != got[0][3]


def test_trigrams_of_several_blobs_are_looked_up_once(monkeypatch):
    texts = ["a b c a b d", "a b c", "d c a b c"]
    codes, owner = lm_scoring.tokens(texts)
    blobs = [b for _, b in lm_scoring.Asking(1, np.zeros(0, np.uint64), {}).blobs(codes, owner, np.array([True, True, False]))]
    base, looked, score = lm_scoring.Base(np.zeros(0, np.uint64), np.zeros(0), 11, 5), [], elias_fano.Trie.score
    monkeypatch.setattr(elias_fano.Trie, "score", lambda self, v, times, words, u, w: looked.append(len(u)) or score(self, v, times, words, u, w))
    whole = list(lm_scoring.answers(blobs * 3, base, 0.75))
    assert len(set(whole)) == 1 and len(whole) == 3
    list(lm_scoring.answers(blobs, base, 0.75))
    assert looked[0] == looked[1] and len(looked) == 2
    monkeypatch.setattr(elias_fano.Trie, "SCORED", 2)
    assert list(lm_scoring.answers(blobs * 3, base, 0.75)) == whole


@pytest.mark.parametrize("m", [50, 1 << 21])
def test_distinct_trigrams(m):
    """Also with so many words that a trigram is no single number."""
    v, u, w = np.random.default_rng(5).integers(0, 6, (3, 400)) * (m // 6)
    *grams, of, order = lm_scoring.distinct_trigrams(v, u, w, m)
    assert list(zip(*(g.tolist() for g in grams), strict=True)) == sorted(set(zip(v.tolist(), u.tolist(), w.tolist(), strict=True)))
    assert all((g[of] == x).all() for g, x in zip(grams, (v, u, w), strict=True)) and (np.diff(of[order]) >= 0).all()
