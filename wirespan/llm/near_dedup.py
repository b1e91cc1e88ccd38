"""Near duplicates by improved consistent weighted sampling.

A text is a weighted set: its shingles of five words (split at ASCII white
space), each weighing its count times its IDF. In op1 and the pipeline the IDF
is ln((1 + N) / (1 + df)) + 1 for every shingle, by its bucket of 2 ** 20 as in
HashingTF and IDF (idf_table). Callers that do not ask for it get an IDF for
common shingles alone (common_shingles): it is 1 for a shingle of
less than a tenth of all documents and falls with the logarithm of the document
frequency, to a half at least; so only shingles that a tenth of the documents
have need an exact frequency, and there are at most ten times as many of them
as a document has shingles. They are found exactly: counts by bucket first,
then of the shingles in buckets that reach a tenth.

Each document draws BANDS x ROWS consistent weighted samples, each of which two
documents share with the probability of their weighted Jaccard similarity.
Documents that share a band are candidates. Texts with equal weighted sets are
one vertex from the start. In a bucket of candidates all are held against one
of them, drawn by hash. A bucket that then still spans several components is
worked on: all outside its largest component are held against all of it, so
that no pair which shares a band and may join two components is left out. In
buckets of at most PAIRS such pairs these are rows. Larger buckets, or what
hangs together by them where that is less work, are dealt in blocks of texts,
and a task computes the similarities of two blocks as a matrix product and puts
out only the links that join components. At a similarity of 0.8 a pair shares
one of 20 bands with a probability of 0.99997. A pair is verified by its texts'
weighted Jaccard similarity; pairs of rows whose total weights exclude it are
not looked up.

A text of fewer than five words is one shingle; texts without words (null too)
are equal. Rows are told apart by id and text, so repeated rows and ids are
fine, and null ids are a value. Further columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.bloom import suspects
from wirespan.llm.common import by_group, materialised, read, text_of
from wirespan.llm.memo import slices, trimmed
from wirespan.operators.components import connected_components

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
#: Document frequency, as a share of all documents, from which a shingle weighs less than its count.
COMMON = 0.1
BUCKETS = 1 << 16
#: Buckets of document frequencies, and the steps of their IDF: one of a rare shingle is so many.
IDF_BUCKETS, IDF_STEPS = 1 << 20, 16
#: Characters at a time whose shingles are made; of pairs of texts twice as many, which the table of powers still covers.
SHINGLE_CHARS = 1 << 18
SALTS = 16
#: Buckets of up to so many pairs to verify have them as rows; larger ones go in blocks.
PAIRS = 1024
#: A block has about so many texts, or so much weight, at most, so that a task's memory is bounded.
BLOCK_TEXTS, BLOCK_WEIGHT = 512, 400_000
#: Shingles of a matrix product at a time.
COLUMNS = 2048
BASE, MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: A worker keeps so many powers, as a power of 2; longer tables are made for one call.
POWER_BITS = 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        x = np.full(n, b)
        x[0] = 1
        out.append(np.multiply.accumulate(x, out=x))
    return tuple(out)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << POWER_BITS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to 0, 1, ... below n at least, and the same of its inverse modulo 2 ** 64."""
    return _kept_powers() if n <= 1 << POWER_BITS else _powers(n)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, text by text and sorted in each: text number, hash, count."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    lengths = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = sums[1:]
    np.add(data, np.uint64(1), out=terms)
    np.multiply(terms, up[: len(data)], out=terms)
    np.cumsum(terms, out=terms)
    word = mixed((sums[ends] - sums[starts]) * down[starts])
    text = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    count = np.bincount(text, minlength=len(texts))
    short = np.minimum(count, words)[text]  # words that a shingle from here has
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[text]
    here = place + short <= count[text]
    at = np.flatnonzero(here)
    code = np.zeros(len(at), np.uint64)
    for k in range(words):
        code = np.where(k < short[at], code * MIX2 + word[np.minimum(at + k, len(word) - 1)] + np.uint64(k), code)
    code, text = mixed(code), text[at]
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])]))
    return text[new], code[new], np.diff(new, append=len(code))


@cache
def gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2 ** 16 equal shares, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


def samples(text: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text that has shingles, in text order: an array (texts, n) of sample codes.

    For a shingle of weight w: r, c ~ Gamma(2, 1), b ~ U(0, 1) from its hash; t = floor(ln w / r + b), and the shingle
    with the least ln c - r (t - b) - r is drawn, as the pair of itself and t.
    """
    r_of = gamma_quantiles().astype(np.float32)
    # 1024 keeps values positive, whose bits order as they do; weights stay far below e ** 1000.
    c_of = (np.log(gamma_quantiles()) + 1024).astype(np.float32)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    odd = np.flatnonzero(weight != 1)
    log_w = np.log(weight[odd]).astype(np.float32)
    factors = mixed(np.arange(1, n + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    packed = np.empty(len(code), np.uint64)
    value, name = packed.view(np.uint32)[1::2], packed.view(np.uint32)[0::2]  # little-endian: the value leads
    low = code.astype(np.uint32)
    name[:] = low
    out = np.empty((len(starts), n), np.uint32)
    for k in range(n):
        parts = (code * factors[k]).view(np.uint16).reshape(-1, 4)
        r = r_of.take(parts[:, 3])
        b = parts[:, 1] * np.float32(1 / 65536)
        v = c_of.take(parts[:, 2]) + r * (b - np.float32(1))
        if odd.size:
            t = np.floor(log_w / r[odd] + b[odd])
            v[odd] -= r[odd] * t
            name[odd] = low[odd] + t.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1)
        value[:] = v.view(np.uint32)
        out[:, k] = np.minimum.reduceat(packed, starts).astype(np.uint32)
    return out


class Weights:
    """Counts times IDF; ``common`` has the hashes whose IDF is less than 1 and their IDF, or ``table`` the IDF of all by bucket, in IDF_STEPS."""

    def __init__(self, common: dict[int, float], table: np.ndarray | None = None):
        self.table = table
        self.code = np.array(sorted(common), np.uint64)
        self.idf = np.array([common[int(c)] for c in self.code])

    def of(self, code: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = count.astype(np.float64)
        if self.table is not None:
            weight *= self.table[(code % np.uint64(IDF_BUCKETS)).astype(np.intp)] / IDF_STEPS
        elif len(self.code):
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            hit = self.code[at] == code
            weight[hit] *= self.idf[at[hit]]
        return weight


def similar_pairs(left: list[str], right: list[str], weights: Weights, threshold: float, words: int) -> np.ndarray:
    """Which texts of left and right have at least the weighted Jaccard similarity: a matrix of booleans.

    A shingle that a text has k times counts as k shingles, each weighing its IDF, so that the least of two weights adds
    up as a product of matrices of zeros and ones.
    """
    n = len(left)
    text, code, count = shingles([*left, *right], words)
    idf = weights.of(code, np.ones(len(code), np.int64))
    total = np.bincount(text, idf * count, n + len(right))
    again = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text, code, idf = np.repeat(text, count), np.repeat(code, count), np.repeat(idf, count)
    code = np.where(again > 0, mixed(code + again.astype(np.uint64) * BASE), code)
    distinct, column = np.unique(code, return_inverse=True)
    of_left = text < n
    holders = np.stack([np.bincount(column[of_left], minlength=len(distinct)), np.bincount(column[~of_left], minlength=len(distinct))])
    pairs = holders[0] * holders[1]
    both = np.zeros((n, len(right)))
    dense = np.flatnonzero(pairs * 16 > both.size)  # others are cheaper pair by pair
    place = np.full(len(distinct), -1)
    place[dense] = np.arange(len(dense))
    for begin in range(0, len(dense), COLUMNS):
        here = (place[column] >= begin) & (place[column] < begin + COLUMNS)
        grid = np.zeros((n + len(right), min(COLUMNS, len(dense) - begin)))
        grid[text[here], place[column[here]] - begin] = np.where(of_left[here], idf[here], 1.0)
        both += grid[:n] @ grid[n:].T
    loose = np.flatnonzero((pairs > 0) & (place < 0))
    order = np.argsort(column, kind="stable")  # left texts of a shingle come before right ones
    first = np.searchsorted(column[order], loose)
    ends = np.cumsum(pairs[loose])
    for begin, end in _runs(ends, 1 << 20):
        at, k = loose[begin:end], pairs[loose[begin:end]]
        number = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        width, start = np.repeat(holders[1][at], k), np.repeat(first[begin:end], k)
        a = order[start + number // width]
        b = order[start + np.repeat(holders[0][at], k) + number % width]
        both += np.bincount(text[a] * len(right) + text[b] - n, idf[a], both.size).reshape(both.shape)
    return both >= threshold * (total[:n, None] + total[None, n:] - both) * (1 - 1e-12)


def _runs(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of items whose sizes, given by their running sum, add up to about ``most``."""
    cuts = np.flatnonzero(np.diff(ends // most, prepend=0)).tolist()
    bounds = sorted({0, *cuts, len(ends)})
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def common_shingles(texts: DataFrame, n: int, words: int) -> dict[int, float]:
    """The IDF of every shingle that at least COMMON of all n documents have."""

    def each(batches):
        for batch in batches:
            for _, found in slices(batch.column("text"), SHINGLE_CHARS):
                yield shingles(found, words)[1]

    def buckets(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for code in each(batches):
            counts += np.bincount((code % np.uint64(BUCKETS)).astype(np.intp), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    least = max(2.0, COMMON * n)
    heavy = texts.mapInArrow(buckets, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    full = np.zeros(BUCKETS, bool)
    full[[r.bucket for r in heavy.collect()]] = True  # at most ten buckets for each shingle of a mean document
    if not full.any():
        return {}

    def counted(batches):
        for code in each(batches):
            code, times = np.unique(code[full[(code % np.uint64(BUCKETS)).astype(np.intp)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(times)], ["code", "n"])

    counts = texts.mapInArrow(counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    idf = lambda df: max(0.5, min(1.0, np.log(n / df) / np.log(1 / COMMON)))
    return {r.code % (1 << 64): idf(r.n) for r in counts.collect()}


def idf_table(texts: DataFrame, n: int, words: int) -> np.ndarray:
    """The IDF of every shingle by bucket, from the frequencies of buckets over all n documents, a shingle once for each that has it.

    Shingles of a bucket share its frequency, so a rare one has that of the median bucket at least, some thousandth of the
    documents. Only ratios of weights count: the median bucket's IDF is IDF_STEPS, and others are rounded to whole steps, so
    that most shingles weigh their count, which draws faster. The table is as large for any input.
    """

    def buckets(batches):
        counts = np.zeros(IDF_BUCKETS, np.int64)
        for batch in batches:
            for _, found in slices(batch.column("text"), SHINGLE_CHARS):
                np.add.at(counts, (shingles(found, words)[1] % np.uint64(IDF_BUCKETS)).astype(np.intp), 1)
        at = np.flatnonzero(counts)
        for begin in range(0, len(at), BUCKETS):
            some = at[begin : begin + BUCKETS]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    found = texts.mapInArrow(trimmed(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(IDF_BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    idf = lambda df: np.log((1 + n) / (1 + np.minimum(df, n))) + 1
    rare = np.median(counts[counts > 0]) if counts.any() else 0
    return np.clip(np.rint(IDF_STEPS * idf(counts) / idf(rare)), 1, 255).astype(np.uint8)


def salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", full_idf: bool = False) -> DataFrame:
    """One row per input row: doc_id, text_key, class_id (the least id of its class), class_size (rows), kept.

    A class is a connected component of links of at least ``threshold``. Of the rows of its least id the one with the
    least text_key (the text's xxhash64) is kept, with its repetitions. With ``full_idf`` every shingle weighs by its document
    frequency, else common ones alone.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    n = texts.count()
    only = texts.select("text")
    weights = spark.sparkContext.broadcast(Weights({}, idf_table(only, n, words)) if full_idf else Weights(common_shingles(only, n, words)))
    keyed = texts.withColumn("text_key", F.xxhash64("text"))

    def signatures(batches):
        for batch in batches:
            for part, found in slices(batch.column("text"), SHINGLE_CHARS):
                size = len(found)
                text, code, count = shingles(found, words)
                weight = weights.value.of(code, count)
                at = np.unique(text)
                one, two, total = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size)
                if len(at):
                    starts = np.flatnonzero(np.diff(text, prepend=-1))
                    one[at] = np.add.reduceat(mixed(code) * count.astype(np.uint64), starts)
                    two[at] = np.add.reduceat(mixed(code + BASE) * count.astype(np.uint64), starts)
                    total[at] = np.add.reduceat(weight, starts)
                    drawn = samples(text, code, weight, bands * rows).astype(np.uint64).reshape(len(at), bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(at), bands)).copy()
                    for k in range(rows):
                        key = mixed(key * MIX + drawn[:, :, k] + BASE)
                has = np.zeros(size, bool)
                has[at] = True
                flat = pa.array(key.view(np.int64).ravel()) if len(at) else pa.array([], pa.int64())
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)), flat)
                kept = batch.slice(part.start, size)
                columns = [kept.column(0), kept.column(1), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(total), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "c1", "c2", "size", "keys"])

    source = keyed.select("doc_id", "text_key", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key bigint, c1 bigint, c2 bigint, size double, keys array<bigint>"
    signed = materialised(source.mapInArrow(trimmed(signatures), schema))

    # Equal weighted sets are one vertex, of which the least row lends its text.
    sets = ["c1", "c2"]
    vertices = signed.groupBy(*sets).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.count("*").alias("copies"))
    vertices = materialised(vertices.select(*sets, F.monotonically_increasing_id().alias("v"), "first", "size", "keys", "copies"))

    def buckets(rows: DataFrame) -> DataFrame:
        """Rows (key, v, size) of keys that several vertices have, with their number n."""
        several = materialised(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        return materialised(by_group(rows, several, ["key"], "n", "v").select("key", "v", "size", "n"))

    members = buckets(vertices.select(F.explode("keys").alias("key"), "v", "size"))
    wanted = materialised(members.select("v").distinct().join(vertices.select("v", "first"), "v").select("v", "first.doc_id", "first.text_key"))
    likely = suspects(wanted.select(F.col("text_key").alias("key"))).filtered(keyed, F.col("text_key"))
    same_row = likely.doc_id.eqNullSafe(wanted.doc_id) & (likely.text_key == wanted.text_key)
    bodies = materialised(likely.join(wanted, same_row).dropDuplicates(["v"]).select("v", "text"))

    def verified(batches):
        for batch in batches:
            for part, a in slices(batch.column("a_text"), SHINGLE_CHARS):  # of similar length are only texts that are compared
                size = len(a)
                text, code, count = shingles([*a, *batch.column("b_text").slice(part.start, size).to_pylist()], words)
                weight = weights.value.of(code, count)
                cut = np.searchsorted(text, np.arange(2 * size + 1))
                good = []
                for i in range(size):
                    left, right = slice(cut[i], cut[i + 1]), slice(cut[size + i], cut[size + i + 1])
                    _, x, y = np.intersect1d(code[left], code[right], assume_unique=True, return_indices=True)
                    both = np.minimum(weight[left][x], weight[right][y]).sum()
                    good.append(both >= threshold * (weight[left].sum() + weight[right].sum() - both) * (1 - 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(part.start, size).filter(pa.array(good)) for k in (0, 1)], ["a", "b"])

    def check(pairs: DataFrame) -> DataFrame:
        right = bodies.select(F.col("v").alias("b"), F.col("text").alias("b_text"))
        dealt = pairs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
        # A text goes to as many tasks as its pairs are dealt to, not to all salts.
        left = bodies.select(F.col("v").alias("a"), F.col("text").alias("a_text")).join(dealt.select("a", "salt").distinct(), "a")
        both = dealt.join(right, "b").join(left, ["a", "salt"])
        return both.select("a", "b", "a_text", "b_text").mapInArrow(trimmed(verified), "a bigint, b bigint")

    similar_size = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b) * (1 - 1e-12)
    tested = links = parts = None

    def test(pairs: DataFrame) -> None:
        """Verify the pairs (a, b) that have not been yet, and bring links and components up to date."""
        nonlocal tested, links, parts
        pairs = materialised(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        new = materialised(check(pairs))
        tested = pairs if tested is None else tested.union(pairs)
        if links is None or new.limit(1).count():
            links = new if links is None else links.union(new)
            parts = connected_components(links)

    def still_open(rows: DataFrame) -> DataFrame:
        """Rows of buckets that span several components, with their component, the bucket's largest one, and how many are not in it."""
        at = materialised(rows.join(parts, "v", "left").withColumn("component", F.coalesce("component", "v")))
        each = at.groupBy("key", "component").agg(F.count("*").alias("n_component"))
        spans = each.groupBy("key").agg(F.max(F.struct("n_component", "component")).alias("main"), F.sum("n_component").alias("all"), F.count("*").alias("components"))
        spans = spans.where("components > 1").select("key", F.col("main.component").alias("main"), (F.col("all") - F.col("main.n_component")).alias("outside"), "all")
        return materialised(by_group(at, materialised(spans), ["key"], "all", "v").drop("all"))

    def hubs(rows: DataFrame) -> DataFrame:
        """For each bucket, one of its vertices by hash."""
        return rows.groupBy("key").agg(F.array(F.min_by(F.struct("v", "size", "component"), F.xxhash64("key", "v"))).alias("hubs"), F.count("*").alias("all"))

    def against(rows: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of rows and the hubs of their buckets that differ in component and are of a similar size."""
        met = by_group(rows, materialised(others), ["key"], "all", "v").select("v", "size", "component", F.explode("hubs").alias("hub"))
        met = met.where((F.col("hub.v") != F.col("v")) & (F.col("hub.component") != F.col("component")) & similar_size("size", "hub.size"))
        return met.select(F.least("hub.v", "v").alias("a"), F.greatest("hub.v", "v").alias("b"))

    def outsiders(rows: DataFrame) -> DataFrame:
        """Pairs of vertices outside a bucket's largest component, and of these with all of it."""
        out = rows.where("component != main").select("key", "n", F.struct("v", "size", "component").alias("hub"))
        return against(rows, out.groupBy("key").agg(F.collect_list("hub").alias("hubs"), F.max("n").alias("all")))  # fewer than PAIRS

    def units(rows: DataFrame) -> DataFrame:
        """Rows (unit, v, size, component, out): buckets, or all that hang together by buckets where that has fewer pairs."""
        rows = rows.withColumn("out", F.col("component") != F.col("main")).select("key", "v", "size", "component", "out")
        least = rows.groupBy("key").agg(F.min("v").alias("hub"), F.count("*").alias("all"))
        whole = connected_components(by_group(rows, materialised(least), ["key"], "all", "v"), "v", "hub").withColumnRenamed("component", "whole")
        rows = materialised(rows.join(whole, "v"))
        counts = rows.groupBy("whole", "key").agg((F.count("*") * F.count_if("out")).alias("pairs")).groupBy("whole").agg(F.sum("pairs").alias("pairs"))
        once = rows.groupBy("whole", "v").agg(F.any_value("size").alias("size"), F.any_value("component").alias("component"), F.bool_or("out").alias("out"))
        better = once.groupBy("whole").agg((F.count("*") * F.count_if("out")).alias("of_whole")).join(counts, "whole").where("of_whole <= pairs").select("whole")
        better = materialised(better)
        single = rows.join(better, "whole", "left_anti").select(F.col("key").alias("unit"), "v", "size", "component", "out")
        return single.union(materialised(once).join(better, "whole").select(F.xxhash64("whole", F.lit("whole")).alias("unit"), "v", "size", "component", "out"))

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        """Links (a, b) of two blocks, as few as join what their links join."""
        left, right = frame[frame.left], frame[~frame.left]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        alike = similar_pairs(left.text.tolist(), right.text.tolist(), weights.value, threshold, words)
        alike &= left.component.to_numpy()[:, None] != right.component.to_numpy()[None, :]
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = c = root.get(root[c], root[c])
            return c

        a, b = (left.v.to_numpy(), left.component.tolist()), (right.v.to_numpy(), right.component.tolist())
        found = []
        for i, j in np.argwhere(alike).tolist():
            x, y = top(a[1][i]), top(b[1][j])
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((min(a[0][i], b[0][j]), max(a[0][i], b[0][j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    def block_links(rows: DataFrame) -> DataFrame:
        """Links between vertices outside the largest component of a bucket and all of it, by blocks of texts."""
        rows = materialised(units(rows))
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_WEIGHT))
        sizes = rows.groupBy("unit").agg(blocks(F.count_if("out"), F.coalesce(F.sum(F.when(F.col("out"), F.col("size"))), F.lit(0.0))).alias("n_left"), blocks(F.count("*"), F.sum("size")).alias("n_right"))
        dealt = rows.join(materialised(sizes), "unit")  # written tables, whose skewed keys Spark splits
        number = lambda n: F.pmod(F.xxhash64("v", F.lit("block")), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        left = dealt.where("out").select("unit", number(F.col("n_left")).alias("i"), every(F.col("n_right")).alias("j"), F.lit(True).alias("left"), "v", "component")
        right = dealt.select("unit", every(F.col("n_left")).alias("i"), number(F.col("n_right")).alias("j"), F.lit(False).alias("left"), "v", "component")
        texts = left.union(right).join(bodies, "v")
        return texts.select("unit", "i", "j", "left", "v", "component", "text").groupBy("unit", "i", "j").applyInPandas(compared, "a bigint, b bigint")

    first = members.withColumn("component", F.col("v"))
    test(against(first, hubs(first)).distinct())
    at = still_open(members)
    small = F.col("outside") * F.col("n") <= PAIRS
    test(outsiders(at.where(small)).distinct())
    at = still_open(at.where(~small).select("key", "v", "size", "n"))
    if at.limit(1).count():
        links = links.union(materialised(block_links(at)))
        parts = connected_components(links)

    named = materialised(vertices.join(parts, "v", "left").select(*sets, F.coalesce("component", "v").alias("component"), "first", "copies"))
    classes = named.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"), F.count("*").alias("sets"))
    classes = by_group(named.select(*sets, "component", "copies"), materialised(classes), ["component"], "sets", "c1").select(*sets, "keep", "class_size", "copies")
    out = by_group(signed.select("doc_id", "text_key", *sets), materialised(classes), sets, "copies", "text_key")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_key") == F.col("keep.text_key"))
    return out.select("doc_id", "text_key", F.col("keep.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows that near_duplicates keeps, in their own columns."""
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    gone = judged.where(~F.col("kept")).select("doc_id", "text_key").distinct()
    key = F.xxhash64(text_of(text_col))
    return docs.join(gone, docs[id_col].eqNullSafe(gone.doc_id) & (key == gone.text_key), "left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), full_idf=True).drop("text_key")
