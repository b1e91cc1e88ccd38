"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under their most frequent form.

Occurrences are counted in tasks, which hand on what a bounded table of words
holds, and summed by word. Two words are near if the longer one without one
letter is the shorter one, or if both are equal but for the letter at one
place. For this a word has three kinds of keys: its own hash, the hash of it
without each letter, and the latter with the place. All come at once, for a
batch of words, from polynomial hashes of prefixes and suffixes: without
letter i, the hash is that of the prefix plus that of the suffix, moved down
by one power. Keys (64 bits) are dealt by their leading bits and sorted; only
words of keys that may make a pair go on, where their strings are looked up
and grouped by the remaining string itself, so that a collision of hashes
never counts.

Words of a group differ by one letter, so a group is bounded by the alphabet
(90 letters) times the word's length, whatever the corpus. Of a group each
word takes only the number of others and the best of them; pairs are not made.

Null texts have no words, a null id is an empty one in the hash, repeated rows
count each time, further columns are ignored. Long texts are counted in
slices, and words of any length are words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import materialised, read, text_of
from wirespan.llm.near_dedup import BASE, mixed, powers

LETTERS, OCCURRENCES, FREQUENT = 6, 5, 5
#: One in so many pairs of document and run loses a letter.
SLIPS = 199
#: A task hands its counts on from so many words.
HELD = 200_000
SLICE_CHARS = 1_000_000
#: Keys are dealt by so many leading bits.
RADIX_BITS = 12
OTHER = re.compile("[^A-Za-zÀ-ÿ]")
#: By Latin-1 code: letters of a run with A-Z lower-cased, a space for the rest (a question mark too, which stands for what Latin-1 lacks).
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WHOLE, SHORTER, PLACED = 0, 1, 2


def parts(text: str):
    """The text in slices that cut no run."""
    begin = 0
    while begin < len(text):
        cut = OTHER.search(text, begin + SLICE_CHARS)
        end = cut.start() if cut else len(text)
        yield text[begin:end]
        begin = end


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = OCCURRENCES) -> DataFrame:
    """word, n: distinct words of at least LETTERS letters, after slips, and how often they occur."""

    def emit(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                for part in parts(text.as_py()):
                    for word, n in Counter(part.encode("latin-1", "replace").translate(RUNS).split()).items():
                        if len(word) < LETTERS:
                            continue
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % SLIPS == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LETTERS:
                                continue
                        held[word] = held.get(word, 0) + n
                    if len(held) >= HELD:
                        yield emit(held)
                        held.clear()
        if held:
            yield emit(held)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(text_col))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every key of every word: its hash, the word's number, its kind and the letter's place (-1 for WHOLE).

    Of a run of equal letters only the first makes a SHORTER key, as all leave the same string.
    """
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    end = np.cumsum(length)
    start = end - length
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(data))
    prefix, suffix = sums[at] - sums[start[of]], sums[end[of]] - sums[at + 1]
    without = (prefix + suffix * INVERSE) * down[start[of]]
    place = at - start[of]
    own = mixed((sums[end] - sums[start]) * down[start] + length.astype(np.uint64) * BASE)
    shorter = mixed(without + (length[of] - 1).astype(np.uint64) * BASE)
    placed = mixed(shorter + (place + 1).astype(np.uint64) * BASE)
    first = np.concatenate([[True], (data[1:] != data[:-1]) | (of[1:] != of[:-1])])
    key = np.concatenate([own, shorter[first], placed])
    kind = np.repeat(np.array([WHOLE, SHORTER, PLACED], np.int8), [len(own), first.sum(), len(placed)])
    return key, np.concatenate([np.arange(len(words)), of[first], of]), kind, np.concatenate([np.full(len(words), -1), place[first], place])


def _may_pair(batches):
    """Of rows sorted by key, those whose key has several words that may be near: PLACED ones, or SHORTER ones and a WHOLE one."""
    rest = None
    names = ["key", "id", "kind", "at"]

    def good(table: pa.Table) -> pa.Table:
        key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(starts, append=len(key))
        whole = np.add.reduceat((kind == WHOLE).astype(np.int64), starts)
        placed = np.add.reduceat((kind == PLACED).astype(np.int64), starts)
        keep = (placed > 1) | ((whole > 0) & (size - placed > whole))
        return table.filter(pa.array(np.repeat(keep, size)))

    for batch in batches:
        table = pa.Table.from_batches([batch]).rename_columns(names)
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not len(table):
            continue
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut:
            yield from good(table.slice(0, cut)).to_batches()
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield from good(rest).to_batches()


def near_words(words: DataFrame, bits: int = 64) -> DataFrame:
    """word, n_near, best (struct of less = -n, and word) for words (word, n; each once) that have near ones.

    Of keys the leading ``bits`` count; fewer make more of them collide, which changes no result.
    """

    def keyed(batches):
        for batch in batches:
            ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) for w in words])
            cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE_CHARS, prepend=0))).tolist(), len(words)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    key, of, kind, at = deletion_keys(words[a:b])
                    key = (key >> np.uint64(64 - bits)) << np.uint64(64 - bits)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[a:b][of]), pa.array(kind), pa.array(at.astype(np.int32))], ["key", "id", "kind", "at"])

    numbered = materialised(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    keys = numbered.select("id", "word").mapInArrow(keyed, "key bigint, id bigint, kind tinyint, at int")
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    found = materialised(dealt.mapInArrow(_may_pair, "key bigint, id bigint, kind tinyint, at int"))
    left = F.expr("case when kind = 0 then word else concat(substring(word, 1, at), substring(word, at + 2)) end")
    strings = found.join(numbered, "id").select("key", F.expr("case when kind = 2 then at end").alias("place"), left.alias("left"), "kind", F.struct((-F.col("n")).alias("less"), "word").alias("w"))
    groups = strings.groupBy("key", "place", "left").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == WHOLE, F.col("w")))).alias("short"), F.array_sort(F.collect_list(F.when(F.col("kind") != WHOLE, F.col("w")))).alias("long"))
    # Words of one place are near each other; else the shorter word is near each longer one.
    replaced = groups.where("place is not null and size(long) > 1").select(F.explode("long").alias("w"), "long").selectExpr("w.word", "size(long) - 1 as n_near", "if(long[0].word = w.word, long[1], long[0]) as best")
    both = groups.where("place is null and size(short) > 0 and size(long) > 0")
    shorter = both.selectExpr("short[0].word as word", "size(long) as n_near", "long[0] as best")
    longer = both.select(F.explode("long.word").alias("word"), F.lit(1).alias("n_near"), F.col("short")[0].alias("best"))
    return replaced.union(shorter).union(longer).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, steps: int) -> DataFrame:
    """word, root for links (word, form), followed to the last by doubling; no chain has more than ``steps`` links."""
    found = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        found = materialised(found)
        beyond = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        found = found.join(beyond, "root", "left").select("word", F.coalesce("far", "root").alias("root"))
    return found


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents."""
    words = materialised(counts(docs, id_col, text_col))
    near = near_words(words).withColumn("form_n", -F.col("best.less"))
    joined = words.join(near, "word", "left")
    is_form = F.col("form_n") >= FREQUENT * F.col("n")
    formed = materialised(joined.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")))
    most = words.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    # Each form is FREQUENT times as frequent, so chains are short.
    steps = int(math.log(max(1, most / OCCURRENCES), FREQUENT)) + 1
    followed = roots(formed.where("form is not null"), steps)
    return formed.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(read(spark, sf_dir, "documents"))
