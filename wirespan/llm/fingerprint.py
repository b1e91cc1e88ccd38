"""Document fingerprints by a randomised edit embedding.

A pointer walks through a text's characters. At each step the character under
it is put out, and a coin that all texts share, thrown for this step and this
kind of character, says whether it moves on. Texts within a small edit distance
soon walk together again, so that their embeddings differ in few places. The
embedding ends when the pointer leaves the text.

A fingerprint samples SLOTS places of the embedding. Slot s takes, of the steps
that the embedding has, the one of the least hash for s, so that embeddings of
different lengths still mostly sample the same steps, and keeps 16 bits of the
character and the step. The likeness of two fingerprints is the share of equal
slots. Alike are fingerprints that differ in at most d slots; as these cannot lie
in all of d + 1 disjoint bands of slots, alike ones share one of these bands.

A null text counts as empty; the empty text's slots are all zero. Equal texts
have equal fingerprints. Rows stay one to one, repeated ids too. Ids that are
put in order are numbers; null ones come first. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.bloom import suspects
from wirespan.llm.common import by_group, materialised, read, text_of
from wirespan.llm.memo import slices
from wirespan.llm.near_dedup import BASE, MIX2, mixed
from wirespan.operators.components import connected_components

SLOTS, LIKE = 64, 0.8
#: Fingerprints that meet in one task, at most about twice, and pairs of them that are compared together.
BLOCK, TOGETHER = 16384, 200_000
#: Rows of small blocks that a task takes at once, and pairs of two blocks up to which all are compared.
GROUP, SMALL = 20_000, 10_000
#: Coins repeat after so many steps, and so many kinds of characters have coins of their own.
STEPS, KINDS = 4096, 256
#: Texts that walk side by side as one array; what is longer than all but so many texts walks alone.
ABREAST = 32
#: Characters of neighbouring texts that are worked on together.
RUN_CHARS = 2_000_000


@cache
def stays() -> np.ndarray:
    """For each step (its residue) and kind of character, how many steps the pointer stays: until a coin says go."""
    go = mixed(np.arange(1, STEPS * KINDS + 1, dtype=np.uint64) * BASE).reshape(STEPS, KINDS) >> np.uint64(63) == 1
    out, left = np.zeros((STEPS, KINDS), np.int64), np.full(KINDS, 1)
    for step in reversed(range(2 * STEPS)):
        left = np.where(go[step % STEPS], 1, left + 1)
        out[step % STEPS] = left
    return out.ravel()


@cache
def records(slot: int, bits: int) -> np.ndarray:
    """The steps below 2 ** bits at which the least hash of a slot so far changes."""
    least, out = np.uint64(2**64 - 1), []
    for begin in range(0, 1 << bits, 1 << 16):
        step = np.arange(begin, min(begin + (1 << 16), 1 << bits), dtype=np.uint64)
        running = np.minimum.accumulate(np.minimum(mixed((step + np.uint64(1)) * BASE + np.uint64(slot * int(MIX2) % 2**64)), least))
        out.append(np.flatnonzero(running != np.concatenate([[least], running[:-1]])) + begin)
        least = running[-1]
    return np.concatenate(out)


def walk(kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: the step at which the pointer comes to each character, and each text's last step."""
    stay, mask = stays(), STEPS - 1
    order = np.argsort(-sizes, kind="stable")
    begin = np.cumsum(sizes) - sizes
    arrive, step = np.zeros(len(kinds), np.int64), np.zeros(len(sizes), np.int64)
    ordered = sizes[order]
    together = int(ordered[ABREAST]) if len(sizes) > ABREAST else 0
    abreast = len(sizes) - np.searchsorted(ordered[::-1], np.arange(together), side="right")
    first, now = begin[order], step[order]
    for i, k in enumerate(abreast.tolist()):
        at, t = first[:k] + i, now[:k]
        arrive[at] = t
        t += stay[(t & mask) << 8 | kinds[at]]
    step[order] = now
    table = None
    for x in order[:ABREAST]:
        size = int(sizes[x])
        if size > together:
            table = table or stay.tolist()
            t, path = int(step[x]), []
            for kind in kinds[begin[x] + together : begin[x] + size].tolist():
                path.append(t)
                t += table[(t & mask) << 8 | kind]
            arrive[begin[x] + together : begin[x] + size] = path
            step[x] = t
    return arrive, step


def fingerprints(texts: list[str]) -> np.ndarray:
    """An array (texts, SLOTS) of 16-bit codes."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = mixed(codes.astype(np.uint64) * BASE)
    arrive, last = walk((hashes & np.uint64(KINDS - 1)).astype(np.int64), sizes)
    out = np.zeros((len(texts), SLOTS), np.uint16)
    full = np.flatnonzero(sizes)
    if full.size:
        # One increasing sequence of all arrivals: each text's steps after those of the texts before it.
        base = np.cumsum(last) - last
        arrive = arrive + np.repeat(base, sizes)
        bits = max(12, int(last.max()).bit_length())
        for slot in range(SLOTS):
            marks = records(slot, bits)
            step = marks[np.searchsorted(marks, last[full]) - 1]
            char = np.searchsorted(arrive, base[full] + step, side="right") - 1
            code = mixed(hashes[char] + step.astype(np.uint64) * MIX2) & np.uint64(0xFFFF)
            out[full, slot] = np.maximum(code, 1)
    return out


def as_bytes(prints: np.ndarray) -> pa.Array:
    """Each row's codes, two bytes each."""
    return pa.array([row.tobytes() for row in prints.astype(">u2")], pa.binary())


def as_text(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def shown(prints: str) -> Column:
    """The hexadecimal digits of a column of bytes."""
    return F.lower(F.hex(prints))


def fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with their fingerprints, as SLOTS x 4 hexadecimal digits, in a column."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch.column(text_at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(part.start, len(texts)).columns, pa.array(as_text(fingerprints(texts)))], names)

    source = docs.drop(into)
    text_at, names = source.columns.index(text_col), [*source.columns, into]
    return source.mapInArrow(run, source.withColumn(into, F.lit("")).schema)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints in bytes."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    return F.size(F.filter(slots, lambda i: F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2)))) / F.lit(float(SLOTS))


def similar(docs: DataFrame, like: float = LIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint and class_id, the least id of its class."""
    prints = fingerprint(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))).drop("text")
    named = with_class(materialised(prints.select("doc_id", F.unhex("fingerprint").alias("print"))), like)
    return named.select("doc_id", shown("print").alias("fingerprint"), "class_id")


def with_class(rows: DataFrame, like: float = LIKE) -> DataFrame:
    """rows (a written table with doc_id and print, a fingerprint in bytes) with class_id, the least id of the row's class.

    Classes are what links of fingerprints that are alike join; a class without any id has a null class_id. Equal
    fingerprints are one vertex, a number. In each bucket of a band all are held against its least one. Where the others
    then span several components, all outside the largest one are held against all others, in blocks.
    """
    own = materialised(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).withColumn("v", F.monotonically_increasing_id()))
    need = next(k for k in range(1, SLOTS + 1) if k / SLOTS >= like)
    bands = [x.tolist() for x in np.array_split(np.random.default_rng(8).permutation(SLOTS), SLOTS - need + 1)]
    band = lambda i, slots: F.xxhash64(F.lit(i), *[F.substring("print", 2 * s + 1, 2) for s in slots])
    keys = F.array(*[band(i, s) for i, s in enumerate(bands)])
    shared = own.select("v", F.explode(keys).alias("band")).groupBy("band").agg(F.min("v").alias("hub"), F.count("*").alias("n")).where("n > 1")
    # A vertex is the hub of as many buckets as there are bands, at most.
    hubs = own.select(F.col("v").alias("hub"), F.col("print").alias("hub_print"))
    buckets = materialised(shared.join(hubs, "hub"))
    # Only what may share a bucket moves.
    likely = suspects(buckets.select(F.col("band").alias("key"))).filtered(own.select("v", "print", F.explode(keys).alias("band")), F.col("band"))
    alike = likeness(F.col("hub_print"), F.col("print")) >= like
    met = materialised(by_group(likely, buckets, ["band"], "n", "v").select("band", "hub", "v", alike.alias("alike")))
    links = materialised(met.where("alike and hub != v").select("hub", "v").distinct())
    parts = connected_components(links, "hub", "v")

    at = met.where("hub != v").join(parts, "v", "left").select("band", "v", F.coalesce("component", "v").alias("component"))
    spans = materialised(open_buckets(at))
    if spans.limit(1).count():
        open_ = by_group(at, spans, ["band"], "n", "v").join(own.select("v", "print"), "v")
        number = lambda n: F.pmod(F.xxhash64("v", F.lit("block")), n)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        # Of a bucket of one block each way a row moves once, for both sides.
        one = F.expr("n_left = 1 and n_right = 1")
        outside = open_.where((F.col("component") != F.col("main")) & ~one).select("band", number(F.col("n_left")).alias("i"), every(F.col("n_right")).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"), "v", "component", "print")
        inside = open_.select("band", every(F.col("n_left")).alias("i"), number(F.col("n_right")).alias("j"), ((F.col("component") != F.col("main")) & one).alias("left"), F.lit(True).alias("right"), "v", "component", "print")

        # Small buckets are many, so a task's group holds the blocks of about GROUP rows.
        to_meet = spans.agg(F.sum(F.col("n") * (F.col("n_left") + F.col("n_right")))).first()[0]
        groups = int(1 + to_meet // GROUP)

        def compared(frame: pd.DataFrame) -> pd.DataFrame:
            """Links of two blocks each, one at most from an outsider to each component."""
            found = []
            slots = np.frombuffer(b"".join(frame.print), ">u2").astype(np.uint16).reshape(len(frame), SLOTS)
            v, component, is_left, is_right = (frame[c].to_numpy() for c in ("v", "component", "left", "right"))
            for rows_ in frame.groupby(["band", "i", "j"]).indices.values():
                a, b = rows_[is_left[rows_]], rows_[is_right[rows_]]
                if len(a) * len(b) <= SMALL:
                    hit = (slots[a][:, None] == slots[b][None]).sum(2) >= need
                    i, j = np.nonzero(hit & (component[a][:, None] != component[b][None]))
                else:
                    i, j = alike_pairs(slots[a], slots[b], component[a], component[b], need)
                found.append((v[a[i]], v[b[j]]))
            return pd.DataFrame({"hub": np.concatenate([x for x, _ in found]), "v": np.concatenate([x for _, x in found])})

        more = outside.union(inside).withColumn("g", F.pmod(F.xxhash64("band", "i", "j"), F.lit(groups))).groupBy("g").applyInPandas(compared, "hub bigint, v bigint")
        parts = connected_components(links.union(materialised(more)), "hub", "v")
    named = own.join(parts, "v", "left").withColumn("component", F.coalesce("component", "v"))
    classes = materialised(named.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("n")))
    named = materialised(by_group(named, classes, ["component"], "n", "v").select("print", "class_id", "rows"))
    return by_group(rows, named, ["print"], "rows", "doc_id").drop("rows")


def open_buckets(at: DataFrame) -> DataFrame:
    """Bands with rows of ``at`` (band, v, component; without the least vertex, which all were held against) of several components.

    n is how many rows there are, main the component of most of them; n_left and n_right are the blocks that rows outside
    it and all rows make.
    """
    blocks = lambda n: F.ceil(n / BLOCK)
    each = at.groupBy("band", "component").agg(F.count("*").alias("k"))
    spans = each.groupBy("band").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("n"), F.count("*").alias("components")).where("components > 1")
    return spans.select("band", "n", F.col("main.component").alias("main"), blocks(F.col("n") - F.col("main.k")).alias("n_left"), blocks(F.col("n")).alias("n_right"))


def alike_pairs(first: np.ndarray, second: np.ndarray, of_first: np.ndarray, of_second: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks with at least ``need`` equal slots and other components: one for each row of the first and component.

    The blocks share a band, so slots are dealt into bands anew, those that tell most rows apart first: alike rows share
    one of these whole, whatever the blocks hold, and only rows that do are compared.
    """
    few = np.zeros((0, 3), np.int64)
    if not len(first) or not len(second):
        return few[:, 0], few[:, 1]
    agree = [float((np.unique(column, return_counts=True)[1] ** 2.0).sum()) for column in second.T]
    order = np.argsort(agree, kind="stable")
    n_bands, found = SLOTS - need + 1, [few]
    factors = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    for k in range(n_bands):
        band = order[k::n_bands]
        keys = [(x[:, band].astype(np.uint64) * factors[band]).sum(1, dtype=np.uint64) for x in (first, second)]
        by_key = np.argsort(keys[1], kind="stable")
        at, stop = (np.searchsorted(keys[1][by_key], keys[0], side=side) for side in ("left", "right"))
        ends = np.cumsum(stop - at)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], TOGETHER), side="left").tolist() if ends[-1] else []
        for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True):
            count = (stop - at)[a:b]
            i = np.repeat(np.arange(a, b), count)
            j = by_key[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[a:b], count)]
            other = of_first[i] != of_second[j]
            i, j = i[other], j[other]
            hit = (first[i] == second[j]).sum(1) >= need
            found.append(np.stack([i[hit], j[hit], of_second[j[hit]]], 1))
    every = np.concatenate(found)
    _, one = np.unique(every[:, [0, 2]], axis=0, return_index=True)
    return every[one, 0], every[one, 1]


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs (with columns text and key) as ordered runs: ``bucket`` ranges of ids, each with a ``ghost`` row at its end.

    The ghost is the row that follows the bucket: the first of the next one, or of all after the last. Buckets are as many
    as four times the session's shuffle partitions at most, so their bounds and first rows are a bounded list.
    """
    spark = docs.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile(id_col, [i / wanted for i in range(1, wanted)], 0.25 / wanted)))
    levels = max(1, len(cuts).bit_length())
    bounds = F.from_json(F.lit(str([int(c) for c in cuts])), "array<bigint>")
    # How many bounds are at most the id, by binary search; a bound that is not there is beyond every id.
    step = lambda acc, k: F.when(F.get(bounds, acc + k - 1) <= F.col(id_col), acc + k).otherwise(acc)
    bucket = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(levels))]), F.lit(0), step)
    placed = docs.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), "key")).alias("first")).orderBy("bucket").collect()
    at = [(r.first.id, r.first.key, firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    id_type = docs.schema[id_col].dataType.simpleString()
    ghosts = spark.createDataFrame(at, f"g_id {id_type}, g_key bigint, g_bucket int")
    ends = placed.join(F.broadcast(ghosts), placed[id_col].eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")))
    ends = ends.withColumn("bucket", F.col("g_bucket")).drop("g_id", "g_key", "g_bucket").withColumn("ghost", F.lit(True))
    return placed.withColumn("ghost", F.lit(False)).unionByName(ends)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against itself with its last quarter replaced by the next document's start, and against the next one.

    Texts move to their neighbours compressed. Fingerprints are bytes: print and edited_print.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def compressed(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            blobs = pa.array([zip_.compress(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs, *batch.columns[2:]], ["doc_id", "blob", "key", "bucket", "ghost"])

    rows = with_next(texts).select("doc_id", "text", "key", "bucket", "ghost")
    rows = rows.mapInArrow(compressed, f"doc_id {id_type}, blob binary, key bigint, bucket int, ghost boolean")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "key").select("doc_id", "blob", "ghost")

    def judged(held: list[tuple], first: np.ndarray | None, kind: pa.DataType) -> tuple[pa.RecordBatch, np.ndarray]:
        """Rows (id, text, ghost) of a run but its last one, which the one before it needs; the last one's fingerprint."""
        whole = [text for _, text, _ in held]
        real = [i for i in range(len(held) - 1) if not held[i][2]]
        edited = [whole[i][: len(whole[i]) - len(whole[i]) // 4] + whole[i + 1][: len(whole[i]) // 4] for i in real]
        new = whole if first is None else whole[1:]
        prints = fingerprints([*new, *edited])
        own, other = prints[: len(new)], prints[len(new) :]
        own = own if first is None else np.concatenate([first, own])
        mine, following = own[real], own[[i + 1 for i in real]]
        columns = [pa.array([held[i][0] for i in real], kind), pa.array([len(whole[i]) for i in real], pa.int64())]
        columns += [pa.array([hashlib.sha256(x.encode()).digest() for x in edited], pa.binary()), as_bytes(mine), as_bytes(other)]
        columns += [pa.array((mine == x).mean(1), pa.float64()) for x in (other, following)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_hash", "print", "edited_print", "near_edited", "near_next"]), own[-1:]

    def run(batches):
        unzip, held, size, first, kind = zstandard.ZstdDecompressor(), [], 0, None, None
        for batch in batches:
            kind = batch.column(0).type
            for id_, blob, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unzip.decompress(blob).decode()
                if len(held) > 1 and size + len(text) > RUN_CHARS:
                    out, first = judged(held, first, kind)
                    yield out
                    held = held[-1:]
                    size = len(held[0][1])
                held.append((id_, text, ghost))
                size += len(text)
        if len(held) > 1:
            yield judged(held, first, kind)[0]

    return rows.mapInArrow(run, f"doc_id {id_type}, n_chars bigint, edited_hash binary, print binary, edited_print binary, near_edited double, near_next double")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_class(materialised(compare_edited(read(spark, sf_dir, "documents"))))
    prints = [shown("edited_hash").alias("edited_sha256"), shown("print").alias("fingerprint"), shown("edited_print").alias("edited_fingerprint")]
    return rows.select("doc_id", "n_chars", *prints, "near_edited", "near_next", "class_id")
