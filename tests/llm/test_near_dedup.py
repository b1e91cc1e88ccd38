"""Near duplicates against all pairs compared by brute force, and the cases of its docstring."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from wirespan.llm import near_dedup

SCHEMA = "doc_id bigint, text string, key string, component string, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def shingle_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    size = min(5, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def brute_classes(rows, threshold=0.8):
    """Least id of each row's component of links at the threshold; the weights as the module's docstring has them."""
    import math

    sets = [shingle_counts(t) for _, t in rows]
    df = Counter(s for x in sets for s in x)
    n = len(rows)
    least = max(2, 0.1 * n)
    idf = {s: max(0.5, min(1.0, math.log(n / d) / math.log(10))) if d >= least else 1.0 for s, d in df.items()}
    weights = [{s: c * idf[s] for s, c in x.items()} for x in sets]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i, w in enumerate(weights):
        for s in w or ("",):
            holders.setdefault(s, []).append(i)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        x, y = weights[a], weights[b]
        both = sum(min(x[s], y[s]) for s in x.keys() & y.keys())
        if both >= threshold * (sum(x.values()) + sum(y.values()) - both) * (1 - 1e-12):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least_id = {}
    for i, (doc_id, _) in enumerate(rows):
        least_id[root(i)] = min(doc_id, least_id.get(root(i), doc_id))
    return {doc_id: least_id[root(i)] for i, (doc_id, _) in enumerate(rows)}


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.op1_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_and_shared_passage(spark):
    """A group of copies with many edits, and documents that share a passage and little else."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=150)
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(150), rng.randint(0, 6)):
            text[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(text)))
    passage = rng.choices(words, k=60)
    rows += [(1000 + i, " ".join(rng.choices(words, k=30) + passage + rng.choices(words, k=30))) for i in range(80)]
    rows += [(2000 + i, " ".join(rng.choices(words, k=60))) for i in range(400)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (5, "one two"), (4, "one\ntwo"), (6, "one two three"), (7, long), (8, long + " more"), (7, long), (None, "alone here now")]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    classes = sorted((r.doc_id or -1, r.class_id, r.class_size, r.kept) for r in got if r.doc_id is not None)
    assert classes == [(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True), (7, 7, 3, True), (7, 7, 3, True), (8, 7, 3, False)]
    kept = near_dedup.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "component", "salt"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 4: 1, 6: 1, 7: 2, None: 1})


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("words", [3, 5])
def test_samples_estimate_similarity(words):
    """Two texts share a sample with the probability of their weighted Jaccard similarity."""
    import numpy as np

    rng = random.Random(1)
    a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    b = a[:330] + [f"v{i}" for i in range(70)]
    text, code, count = near_dedup.shingles([" ".join(a), " ".join(b)], words)
    drawn = near_dedup.samples(text, code, count.astype(float), 4000)
    x, y = set(code[text == 0].tolist()), set(code[text == 1].tolist())
    assert abs(np.mean(drawn[0] == drawn[1]) - len(x & y) / len(x | y)) < 0.03


def test_shingle_counts_are_exact():
    texts = ["a b c d e f a b c d e", "", "x", "a b c d e"]
    text, code, count = near_dedup.shingles(texts)
    assert sorted(Counter(text.tolist()).items()) == [(0, 6), (2, 1), (3, 1)]
    assert count.max() == 2 and set(code[text == 3]) <= set(code[text == 0])


def test_similar_pairs_against_counts():
    """Blocks of texts, with repeated shingles, shingles of few texts and of many, and texts without words."""
    rng = random.Random(3)
    base = rng.choices("abcdefgh", k=40)
    texts = [" ".join(w if rng.random() < 0.97 else rng.choice("xyz") for w in base) for _ in range(60)] + ["", "a a a a a a a a", "one two", "one two"]
    sets = [shingle_counts(t) for t in texts]
    got = near_dedup.similar_pairs(texts[:50], texts[40:], near_dedup.Weights({}), 0.6, 5)
    for i, x in enumerate(sets[:50]):
        for j, y in enumerate(sets[40:]):
            both = sum((x & y).values())
            assert got[i, j] == (both >= 0.6 * (x.total() + y.total() - both) - 1e-9)


def test_group_of_thousands(spark):
    """Copies with so many edits that few pairs of them reach the threshold, though all share bands."""
    import numpy as np

    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=200)
    rows = []
    for i in range(2400):
        text = list(base)
        for at in rng.sample(range(200), rng.randint(2, 5)):
            text[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(text)))
    sets = [shingle_counts(t) for _, t in rows]
    n, df = len(rows), Counter(s for x in sets for s in x)
    idf = {s: max(0.5, min(1.0, np.log(n / d) / np.log(10))) for s, d in df.items() if d > 1}
    column = {s: k for k, s in enumerate(idf)}
    has = np.zeros((n, len(column)), np.float64)
    for i, x in enumerate(sets):
        assert max(x.values()) == 1
        has[i, [column[s] for s in x if s in column]] = 1
    both = (has * np.array(list(idf.values()))) @ has.T
    total = np.array([sum(idf.get(s, 1.0) for s in x) for x in sets])
    alike = both >= 0.8 * (total[:, None] + total[None, :] - both) * (1 - 1e-12)
    np.fill_diagonal(alike, True)
    label = np.arange(n)
    while True:
        new = np.array([label[a].min() for a in alike])
        if (new == label).all():
            break
        label = new
    assert 100 < len(set(label.tolist())) < n - 100
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert [got[i] for i in range(n)] == label.tolist()
