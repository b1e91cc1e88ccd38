"""URL rules by Bloom filter cascades.

A rule is a host and a path prefix; it fits its host and all subdomains where
the URL's path starts with the rule's. The URL's candidate keys are its host
suffixes and path prefixes of the shapes (labels, path length) that rules have,
one array that a single expression makes for any number of shapes.
Level 0 of a cascade encodes the listed keys; level 1 the keys of the corpus
that level 0 wrongly passes; level 2 the listed keys that level 1 wrongly
passes, and so on until no level errs. As the levels are built against every
candidate key of the corpus, membership is exact for all of them without a
join: a key is listed if the first level that lacks it has an odd number.

Two cascades answer a URL: which candidate keys are rules (the longest wins,
on equal length the longer host), and which of those block. Rules that are
given twice with both verdicts block. No rule: the URL is allowed. A null URL
or one without ``://`` has an empty host and path, which no rule fits. The
input's further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.bloom import Bloom
from wirespan.llm.common import materialised, read

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """The URL's host, A-Z lower-cased, and its path."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both have a column key, whose rows may repeat).

    A level takes some 1.5 bits for each halving of its errors and key, 2 bytes a rule or so in all, and goes to the tasks
    as a constant. The rules are a parameter of the job and do not grow with the corpus.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[tuple[Bloom, Column]] = []
        keep = materialised(listed.select("key").distinct())
        n = keep.count()
        if not n:
            return
        size = universe.agg(F.approx_count_distinct("key")).first()[0]  # only sizes the first level
        # The first level's rate lets about as many keys pass wrongly as are listed; all later levels halve what is left.
        self._add(keep, n, min(0.5, math.sqrt(0.5) * n / max(size, 1)))
        other = materialised(self._passed(universe.select("key")).distinct().join(keep, "key", "left_anti"))
        while n := other.count():
            self._add(other, n, 0.5)
            keep, other = other, materialised(self._passed(keep))

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        level = Bloom(keys, n, rate, len(self.levels), math.inf)
        self.levels.append((level, level.constant()))

    def _passed(self, keys: DataFrame) -> DataFrame:
        level, constant = self.levels[-1]
        return keys.where(level.has(constant, F.col("key")))

    def has(self, key: Column) -> Column:
        """Odd number of levels passed: listed."""
        inside = F.lit(len(self.levels) % 2 == 1)
        for i, (level, constant) in reversed(list(enumerate(self.levels))):
            inside = F.when(level.has(constant, key), inside).otherwise(F.lit(i % 2 == 1))
        return inside


def candidates(host: Column, path: Column, rules: DataFrame) -> Column:
    """The keys by which rules of these (labels, path length) could fit a URL, as one array."""
    shapes = rules.select((F.size(F.split("host", r"\.", -1))).alias("k"), F.length("path").alias("n")).distinct().collect()  # as many as hosts' labels times paths' lengths
    kinds = F.array(*[F.struct(F.lit(r.k).alias("k"), F.lit(r.n).alias("n")) for r in sorted(shapes)])
    labels = F.size(F.split(host, r"\.", -1))
    fit = F.filter(kinds, lambda x: (x["k"] <= labels) & (x["n"] <= F.length(path)) & (host != ""))
    return F.transform(fit, lambda x: key_of(F.call_function("substring_index", host, F.lit("."), -x["k"]), F.substring(path, F.lit(1), x["n"])))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row, by rules (host, path, verdict)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = materialised(rules.select("host", "path", key_of(F.col("host"), F.col("path")).alias("key"), "verdict"))
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules.limit(1).count():
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), rules)
    known = Cascade(rules, urls.select(F.explode(keys).alias("key")))
    blocking = Cascade(rules.where("verdict = 'block'"), rules)
    ranked = F.transform(F.filter(keys, known.has), lambda k: F.struct((F.length(k) - 1).alias("n"), F.locate("\n", k).alias("h"), k.alias("key")))
    out = urls.withColumn("best", F.array_max(ranked)["key"])
    verdict = F.when(F.col("best").isNotNull() & blocking.has(F.col("best")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.translate("best", "\n", "").alias("rule"), verdict.alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = """
with u as (select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end r from pages),
p as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (select page_id, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as verdict
        from p join rules on (p.host = h or p.host like '%.' || h) and starts_with(p.path, rules.p) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fit on p.page_id = fit.page_id
"""
