"""Exact dedup and URL rules against their SQL and the cases of their docstrings."""

from __future__ import annotations

from wirespan.llm import exact_dedup, url_filter
from wirespan.llm.bloom import Bloom
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


def test_exact_table(spark):
    assert assert_same(exact_dedup.op3_exact_dedup(spark, SF), exact_dedup.ORACLE_SQL, SF) > 0


def test_exact_odd_rows(spark):
    long = "A sentence of some length. " * 20_000
    rows = [(5, None), (2, ""), (9, " "), (3, "a  b"), (1, "a\tb"), (7, long), (8, long.replace(". ", ".\n")), (10, long + "x"), (1, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, pos int, key string")
    got = sorted(((r.doc_id or 99, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()))
    assert got == [(1, 1, 4, True), (1, 1, 4, True), (2, 2, 2, True), (3, 1, 4, False), (5, 2, 2, False), (7, 7, 2, True), (8, 7, 2, False), (9, 9, 1, True), (10, 10, 1, True), (99, 1, 4, False)]
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_exact_with_chunk_hashes_that_collide(spark):
    """Chunks told apart by length alone: identifiers are verified by content."""
    rows = [(i, f"{'abc'[i % 3]}" * (10 + i // 6)) for i in range(60)] + [(70, "x. " * 300 + "a" * 300), (71, "x. " * 300 + "b" * 300), (72, "x. " * 300 + "a" * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, chunk_hash=lambda c: exact_dedup.F.length(c).cast("long")).collect()}
    for i, text in rows:
        same = [j for j, other in rows if other == text]
        assert got[i] == (min(same), len(same))


def test_bloom_filter(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    bloom = Bloom(keys, 3000, 0.01)
    others = spark.range(3000, 23000).selectExpr("concat('k', id) as key")
    constant = bloom.constant()
    for passed in (lambda df: bloom.filtered(df, df.key), lambda df: df.where(bloom.has(constant, df.key))):
        assert passed(keys).count() == 3000 and 50 < passed(others).count() < 600


def test_chunks_join_to_the_text(spark):
    text = "One. Two? " * 300 + "世界 without an end" + "x" * 20_000
    row = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks(exact_dedup.F.col("t")).alias("c")).first()
    assert "".join(row.c) == text and max(map(len, row.c)) <= 8192


def test_url_table(spark):
    assert assert_same(url_filter.op5_url_filter(spark, SF), url_filter.ORACLE_SQL, SF) > 0


def verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        import re

        rest = url.split("://", 1)[1]
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_cascade_against_brute_force(spark):
    rules = [*url_filter.RULES, ("net", "", "block"), ("a.net", "/x", "allow"), ("b.a.net", "/", "block")]
    urls = ["http://A.NET/x/y", "https://b.a.net/x", "ftp://net", "http://xnet/", None, "", "no scheme", "http://a.net?x=/x", "x://y://org/", "http://sub.example.org/es/1#f", "http://example.org/en/1", "http://example.org/en/2", "http://example.com/de/", "http:///nohost", "http://é.org/ü"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls * 3)], "page_id bigint, url string, host string, rule string")
    wanted = {i: verdict(u, rules) for i, u in enumerate(urls * 3)}
    got = url_filter.filter_urls(pages, rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == wanted
    assert {(r.rule, r.verdict) for r in url_filter.filter_urls(pages, []).collect()} == {(None, "allow")}
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


def test_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    listed = universe.where("crc32(key) % 50 = 0")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.join(listed.selectExpr("key", "true as own"), "key", "left").where(cascade.has(url_filter.F.col("key")) != url_filter.F.coalesce("own", url_filter.F.lit(False)))
    assert wrong.count() == 0


def test_many_rules_of_many_shapes(spark):
    """Thousands of rules of hundreds of shapes against brute force, without falling back from generated code."""
    import random

    rng = random.Random(2)
    host = lambda: ".".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 80)))
    rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(4000)}.items())
    rules = [(h, p, v) for (h, p), v in rules] + [(h, "/", "block") for h in "abc"]
    by_key = {}
    for h, p, v in rules:
        by_key[h, p] = "block" if "block" in (v, by_key.get((h, p))) else "allow"
    urls = [f"http://{h}{p}{path()}" for h, p, _ in rng.sample(rules, 300)] + [f"http://{host()}{path()}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        labels = r.host.split(".")
        fits = [(len(h) + n, len(h), h, r.path[:n]) for k in range(len(labels)) for h in [".".join(labels[k:])] for n in range(len(r.path) + 1) if (h, r.path[:n]) in by_key]
        best = max(fits) if fits else None
        assert (r.rule, r.verdict) == ((best[2] + best[3], by_key[best[2], best[3]]) if best else (None, "allow"))
