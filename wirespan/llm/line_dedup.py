"""Line dedup by a deletion-neighbourhood join.

Lines are compared with white space runs as one space, trimmed. A line is
dropped if an earlier line of the corpus (by document id, then the text's hash,
then place) is equal or, for lines of NEAR_CHARS characters on, within one edit
of it, whether or not that one stays; so the earliest stays. Blank lines stay.

Within one edit means that both lines, as they are or without one character,
share a variant: same length and the same place left out (one substituted), or
one line is the other without a character. Each variant is a hashed key, and a
line joins the earliest line of its keys; the pair is then verified by its edit
distance. A variant that many lines share makes one pair for each of them.

Variants are made only for lines that can have a partner: one edit leaves the
first or the last half of a line as it is, so a line whose halves (for its own
length and the next) no other line shares is within one edit of none.

A null text counts as empty, which has one empty line. Rows that repeat an id
and a text are one document. Further columns are kept as they are. Texts move
only where lines of theirs are compared or go: Bloom filters of a bounded size
find these in the scan, and what they pass wrongly changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirespan.llm import memo
from wirespan.llm.bloom import suspects
from wirespan.llm.common import SPACE, by_group, materialised, read, text_of
from wirespan.llm.near_dedup import BASE, mixed

#: Lines of fewer characters are dropped as copies only: one edit makes another word of them.
NEAR_CHARS = 20
#: Variants in a record batch, and about as many as a task makes.
BATCH, TASK_VARIANTS = 1 << 16, 1_000_000
#: Two primes below 2 ** 31 and the bases of polynomial hashes modulo them.
PRIMES, BASES = (2147483647, 2147483629), (1315423911, 2038074743)


def trimmed(line: Column) -> Column:
    """The line with white space runs as one space, trimmed; most lines have single spaces only and are searched, not rewritten."""
    odd = F.lit(False)
    for mark in ("  ", "\t", "\n", "\v", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(line, f"[{SPACE}]+", " ")).otherwise(line))


def halves(line: Column) -> Column:
    """Keys of which two lines within one edit share one: their first or last halves, for the longer of the two."""
    n = F.length(line)
    keys = []
    for more in (0, 1):  # the line is the longer of a pair, or its partner has one character more
        half = ((n + more) / 2).cast("int")
        rest = n + more - half
        keys += [F.xxhash64(n + more, F.lit(0), F.substring(line, F.lit(1), half)), F.xxhash64(n + more, F.lit(1), F.substring(line, n - rest + 1, rest))]
    return F.array(*keys)


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of (line without its i-th character, i) and of the line without it, by i; hash of the line."""
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    place = np.arange(n, dtype=np.uint64)
    hashes, whole = np.zeros(n, np.uint64), 0
    for prime, base in zip(PRIMES, BASES, strict=True):
        p = np.uint64(prime)
        power = np.ones(n, np.uint64)
        step, have = base, 1
        while have < n:  # base ** 0 .. base ** (n - 1), doubling
            more = power[: min(have, n - have)] * np.uint64(step) % p
            power[have : have + len(more)] = more
            step, have = step * step % prime, have * 2
        terms = codes % p * power % p
        before = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])) % p
        after = (before[-1] + p - before[1:]) % p * np.uint64(pow(base, -1, prime)) % p
        hashes = hashes << np.uint64(32) | (before[:-1] + after) % p
        whole = whole << 32 | int(before[-1])
    return (hashes ^ (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9), hashes, whole


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that is left, and n_lines, n_copies and n_near (lines dropped as copies or as within one edit).

    A document of which nothing is left has a null text.
    """
    added = ["n_lines", "n_copies", "n_near"]
    keyed = docs.drop(*added).withColumn("_key", F.xxhash64(text_of(text_col)))
    texts = keyed.select(F.col(id_col).alias("doc_id"), F.col("_key").alias("key"), text_of(text_col).alias("text"))
    where = F.struct("doc_id", "key", "no").alias("at")
    split = texts.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    # Asked of the raw line, so that the filter below the projection does not trim each line once more.
    split = split.where(F.col("raw").rlike(f"[^{SPACE}]")).withColumn("line", trimmed(F.col("raw"))).drop("raw")
    names = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")]
    both = F.when(F.length("line") >= near_chars, halves(F.col("line"))).alias("halves")
    lines = materialised(split.select(*names, where, both))

    # Lines that differ have different (h1, h2); the earliest of each stands for it.
    distinct = materialised(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.any_value("halves").alias("halves")))
    halved = distinct.select("at", F.explode("halves").alias("half"))
    shared = halved.groupBy("half").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
    able = by_group(halved, materialised(shared.select("half", "rows")), ["half"], "rows", "at").select("at").distinct()
    wanted = materialised(able.groupBy("at.doc_id", "at.key").agg(F.collect_set("at.no").alias("nos")))
    likely = suspects(wanted.select("key")).filtered(texts, F.col("key"))
    found = likely.join(wanted, likely.doc_id.eqNullSafe(wanted.doc_id) & (likely.key == wanted.key)).select(likely.doc_id, likely.key, "text", "nos").dropDuplicates(["doc_id", "key"])
    pick = F.transform(F.array(F.split("text", "\n")), lambda all_: F.transform("nos", lambda no: F.struct(no.alias("no"), F.get(all_, no).alias("raw"))))[0]
    found = found.select("doc_id", "key", F.inline(pick))
    # Numbers that rise with the lines' order stand for them below.
    bodies = materialised(found.select(where, trimmed(F.col("raw")).alias("line")).orderBy("at").withColumn("number", F.monotonically_increasing_id()))

    def variants(batches):
        held, size = [], 0
        for batch in batches:
            for number, line in zip(batch.column(0).to_numpy(), batch.column(1).to_pylist(), strict=True):
                placed, plain, whole = variant_keys(line)
                plain = np.unique(plain)
                n, m = len(placed), len(plain)
                keys = np.concatenate([placed, plain, np.array([whole], np.uint64)])
                # Role 0: one of those that lack the same place; 1: lacks a character; 2: the line itself. Equal keys have equal lengths.
                role = np.repeat(np.array([0, 1, 2], np.int8), [n, m, 1])
                keys = mixed(keys ^ np.repeat(np.array([2 * n, 2 * n - 1, 2 * n + 1], np.uint64) * BASE, [n, m, 1]))
                held.append((np.full(len(keys), number), role, keys.view(np.int64)))
                size += len(keys)
                if size >= BATCH:
                    yield from _batches(held)
                    held, size = [], 0
        yield from _batches(held)

    # Tasks of about as many variants each, whatever the lines' lengths.
    to_make = bodies.agg(F.coalesce(F.sum(2 * F.length("line").cast("long") + 1), F.lit(0))).first()[0]
    dealt = bodies.select("number", "line").repartition(1 + to_make // TASK_VARIANTS, "number")
    made = dealt.mapInArrow(memo.trimmed(variants), "number bigint, role tinyint, variant bigint")
    # Of one variant are at most as many distinct lines as a character can have values, times a line's places.
    group = Window.partitionBy("variant")
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("number"))).over(group)
    met = made.withColumns({f"first{k}": least(k) for k in (0, 1, 2)})
    # Who lacks a character meets the line itself, and the reverse.
    earlier = F.when(F.col("role") == 0, F.col("first0")).when(F.col("role") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = materialised(met.select("number", earlier.alias("first")).where("first < number").distinct())
    right = bodies.select(F.col("number").alias("first"), F.col("line").alias("earlier"))
    near = pairs.join(bodies, "number").join(right, "first").where(F.levenshtein("line", "earlier", 1) >= 0).select("at").distinct()
    near = near.join(distinct, "at").select("h1", "h2", F.lit(True).alias("near"), F.col("n").alias("n_near"))

    repeated = distinct.where("n > 1").select("h1", "h2", F.col("at").alias("first"), "n")
    judged = repeated.join(near, ["h1", "h2"], "full").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n", "n_near").alias("n"))
    hit = by_group(lines.select("h1", "h2", "at"), materialised(judged), ["h1", "h2"], "n", "at")
    copy = F.col("first").isNotNull() & (F.col("first") < F.col("at"))
    gone = hit.where(copy | F.col("near")).select("at", copy.alias("copy")).distinct()
    gone = gone.groupBy("at.doc_id", "at.key").agg(F.sort_array(F.collect_list("at.no")).alias("gone"), F.count_if("copy").alias("n_copies"), F.count_if(~F.col("copy")).alias("n_near"))
    gone = materialised(gone.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"), F.col("gone").alias("_gone"), "n_copies", "n_near"))
    # A text that loses no line is read and passed on where it is; the filter is asked first, so only few of those move.
    bloom = suspects(gone.select(F.col("_gone_key").alias("key")))
    lines_of = F.split(text_of(text_col), "\n")
    n_lines = F.size(lines_of).cast("long").alias("n_lines")
    own = [c for c in keyed.columns if c != "_key"]
    untouched = bloom.filtered(keyed, F.col("_key"), inside=False).select(*own, n_lines, F.lit(0).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_near"))
    touched = bloom.filtered(keyed, F.col("_key"))
    out = touched.join(gone, touched[id_col].eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left")
    # Runs of lines between those that go; each array is bound once.
    starts, stops = F.concat(F.array(F.lit(1)), F.transform("_gone", lambda i: i + 2)), F.concat("_gone", F.array(F.size(lines_of)))
    runs = lambda all_: F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(all_, a, b - a + 1)))
    left = F.transform(F.array(lines_of), runs)[0]
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).when(F.size("_gone") < F.size(lines_of), F.array_join(left, "\n"))
    kept = [text.alias(c) if c == text_col else F.col(c) for c in own]
    out = out.select(*kept, n_lines, F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return out.unionByName(untouched)


def _batches(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Record batches of at most BATCH variants."""
    if held:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        for a in range(0, len(columns[0]), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + BATCH]) for x in columns], ["number", "role", "variant"])


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs in their own columns with what is left of each text; documents that lost lines and have only white space left go."""
    out = dedup_lines(docs, id_col=id_col, text_col=text_col, **settings)
    left = F.coalesce(F.col(text_col).rlike(f"[^{SPACE}]"), F.lit(False))
    return out.where((F.col("n_copies") + F.col("n_near") == 0) | left).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_copies", "n_near", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no from documents),
t as (select doc_id, no, raw, trim(regexp_replace(raw, '[ 	-
]+', ' ', 'g')) as line from l),
c as (select line, min(doc_id * 1000000 + no) as pos, length(line) as n from t where line != '' group by line),
k as (select line, pos, n, n + more as m, (n + more) // 2 as half, side from c, (values (0), (1)) as v(more), (values (0), (1)) as w(side) where n >= 20),
h as (select line, pos, n, m, side, case side when 0 then left(line, half) else right(line, m - half) end as half from k),
near as (select distinct b.line from h a join h b on a.m = b.m and a.side = b.side and a.half = b.half and a.pos < b.pos and abs(a.n - b.n) <= 1 where levenshtein(a.line, b.line) <= 1),
j as (select t.doc_id, t.no, t.raw, c.pos < t.doc_id * 1000000 + t.no as copy, near.line is not null as near from t left join c on t.line = c.line left join near on t.line = near.line),
s as (select doc_id, no, raw, coalesce(copy, false) as copy, near from j)
select doc_id, count(*) as n_lines, count(*) filter (copy) as n_copies, count(*) filter (near and not copy) as n_near,
       coalesce(length(string_agg(raw, chr(10) order by no) filter (not copy and not near)), 0) as n_chars_left,
       sha256(string_agg(raw, chr(10) order by no) filter (not copy and not near)) as text_sha256
from s group by doc_id
"""
