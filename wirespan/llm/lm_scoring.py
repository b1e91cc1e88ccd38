"""Language-model scores from Elias-Fano n-gram tries.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per
text; words are told apart by 64-bit hashes, in the first and last place of a
trigram by 32 bits of them. Every n-gram of every training text is kept, so the
model grows with the corpus. Its trigrams are dealt by their middle word (that
of a bigram is its first) into shards of about SHARD_TOKENS tokens; a word that
has more than one in SPLIT of all tokens is split by first words, and then each
part has all its bigrams too. A task gathers one shard's counts, makes a trie
of them, maps it and answers the trigrams that texts ask it for.

A seen trigram has (n - D) / n(context); what that leaves goes to the next
shorter context, and from bigrams to (c + 1) / (N + V + 1), the base. The part
of it that falls on words the longer context has seen is left unused, so the
probabilities after a context add up to at most one. Probabilities and weights
are quantised to 8 bits.

Neither the driver nor a broadcast holds more of the model than the words that
have one in FREQUENT of all tokens, of which there are at most FREQUENT; their
counts are known where texts are read, those of other words come from shards
and a join. A text's n-grams leave its task once for each run of about
GROUP_TOKENS tokens, so common ones move once for very many texts.

A null text counts as empty: its one token is the end. Rows stay one to one,
repeated ids too; a null id belongs to training, as crc32 of the empty text is
0. Without training texts every count is 0. Further columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import crc_mod, materialised, read, text_of
from wirespan.llm.elias_fano import Trie
from wirespan.llm.memo import slices
from wirespan.llm.near_dedup import BASE, mixed, powers

DISCOUNT = 0.75
BEGIN, END = np.uint64(1), np.uint64(2)
#: Characters whose words are found together.
SLICE = 750_000
SHARD_TOKENS, SPLIT, FREQUENT = 1 << 20, 256, 1 << 20
#: Tokens and texts whose n-grams leave a task together.
GROUP_TOKENS, GROUP_TEXTS = 1_000_000, 60_000


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text's after a BEGIN and before an END, and the text each belongs to."""
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    word = mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(1) | np.uint64(4)  # below 2 ** 63, and neither mark
    text = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    count = np.bincount(text, minlength=len(texts))
    out, owner = np.empty(len(word) + 2 * len(texts), np.uint64), np.repeat(np.arange(len(texts), dtype=np.int32), count + 2)
    before = np.cumsum(count + 2) - count - 2
    out[before], out[before + count + 1] = BEGIN, END
    out[np.arange(len(word)) + 2 * text + 1] = word
    return out, owner


def short(codes: np.ndarray) -> np.ndarray:
    """The first 32 bits of a word's hash, which stand for it in the first and last place; they sort as the hashes do."""
    return (codes >> np.uint64(31)).astype(np.uint32)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte by byte of the numbers, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes(), *planes]))


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays of pack(), of these kinds of numbers."""
    view = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(view[:4], np.uint32)[0])
    sizes, at, out = np.frombuffer(view[4 : 4 + 4 * n], np.uint32), 4 + 4 * n, []
    for size, kind in zip(sizes.tolist(), kinds.split(), strict=True):
        kind = np.dtype(kind)
        planes = np.frombuffer(view[at : at + size * kind.itemsize], np.uint8).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def steps(sorted_numbers: np.ndarray) -> np.ndarray:
    """Differences of numbers in order, from 0; their running sum gives the numbers again."""
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


#: What is asked of a shard (codes as steps()): words v and how many trigrams each has; rare words and their texts; codes of all u and w; of
#: each trigram how often it was learned and asked, its u and w as numbers of codes (low and high halves), and the texts
#: that ask; split words and how many bigrams each has, with counts and w.
ASKED = "u8 u4 u8 u4 u2 u4 u4 u4 u2 u2 u2 u2 u2 u8 u4 u4 u4"
#: What comes back: texts with their sums; rare words' texts with sums and seen words; texts with open rare words.
ANSWERED = "u2 f4 u2 f8 u4 u2 u4"


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in order."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def ranked(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in order, which of them each is, and the places of all in this order."""
    order = np.argsort(numbers)
    numbers = numbers[order]
    new = np.diff(numbers, prepend=-1) != 0
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return numbers[new], of, order


def distinct_trigrams(v: np.ndarray, u: np.ndarray, w: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of numbers below m, in order, which of them each is, and the places of all in this order."""
    v = v.astype(np.int64)
    if m < 1 << 21:
        grams, of, order = ranked((v * m + u) * m + w)
        return grams // (m * m), grams // m % m, grams % m, of, order
    context, of, _ = ranked(v * m + u)
    grams, of, order = ranked(of * m + w)
    return context[grams // m] // m, context[grams // m] % m, grams % m, of, order


class Asking:
    """The n-grams of a run of texts, by shard."""

    def __init__(self, shards: int, frequent: np.ndarray, parts: dict[int, int]):
        self.shards, self.frequent = shards, frequent
        self.split, self.parts = np.array(sorted(parts), np.uint64), np.array([parts[k] for k in sorted(parts)], np.uint64)

    def home(self, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mixed(v + (part + np.uint64(1)) * BASE) % np.uint64(self.shards)).astype(np.int64)

    def parts_of(self, v: np.ndarray) -> np.ndarray:
        if not len(self.split):
            return np.ones(len(v), np.uint64)
        at = np.minimum(np.searchsorted(self.split, v), len(self.split) - 1)
        return np.where(self.split[at] == v, self.parts[at], np.uint64(1))

    def blobs(self, codes: np.ndarray, owner: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, blob) of texts' tokens; ``owner`` numbers the texts, ``train`` tells which are learned from."""
        words, place = np.unique(codes, return_inverse=True)
        place = place.astype(np.int32)
        at = np.flatnonzero(codes != BEGIN)
        w, v, u = place[at], place[at - 1], place[np.where(codes[at - 1] == BEGIN, at - 1, at - 2)]
        texts, m = owner[at], len(words)
        v, u, w, of, order = distinct_trigrams(v, u, w, m)
        times, learned = np.bincount(of, minlength=len(v)), np.bincount(of, train[texts], len(v)).astype(np.uint32)
        listed = texts[order].astype(np.uint16)
        starts = np.cumsum(times) - times
        parts = self.parts_of(words[v])
        shard = self.home(words[v], np.where(parts > 1, mixed(words[u] * BASE) % parts, 0).astype(np.uint64))

        # All bigrams of split words, for each of their parts.
        big = np.flatnonzero((parts > 1) & (learned > 0))
        pair, back = np.unique(v[big] * m + w[big], return_inverse=True)
        pair_n, pair_v = np.bincount(back, learned[big], len(pair)).astype(np.uint32), pair // m
        copies = self.parts_of(words[pair_v]).astype(np.int64)
        pair_of = np.repeat(np.arange(len(pair)), copies)
        part = np.arange(len(pair_of)) - np.repeat(np.cumsum(copies) - copies, copies)
        # Once for each shard, also where that has several parts of a word.
        there = np.unique(pair_of * self.shards + self.home(words[pair_v[pair_of]], part.astype(np.uint64)))
        pair_of, pair_shard = there // self.shards, there % self.shards

        # Words that are not frequent, with the texts that have them.
        hit = np.minimum(np.searchsorted(self.frequent, words), max(0, len(self.frequent) - 1))
        rare = (self.frequent[hit] != words) if len(self.frequent) else np.ones(m, bool)
        rare &= words != BEGIN
        mine = np.flatnonzero(rare[place[at]])
        mine = mine[np.argsort(place[at][mine], kind="stable")]
        rare_word, rare_text = place[at][mine], texts[mine].astype(np.uint16)
        rare_shard = self.home(words[rare_word], np.zeros(len(mine), np.uint64))

        # Numbers of two bytes are sorted by their digits.
        shard, pair_shard, rare_shard = (x.astype(np.min_scalar_type(self.shards)) for x in (shard, pair_shard, rare_shard))
        order, pair_order, rare_order = (np.argsort(x, kind="stable") for x in (shard, pair_shard, rare_shard))
        has, rank = np.zeros(m, bool), np.empty(m, np.int64)
        ends = [np.searchsorted(x[o], np.arange(self.shards + 1)) for x, o in ((shard, order), (pair_shard, pair_order), (rare_shard, rare_order))]
        for s in range(self.shards):
            own, own_pairs, own_rare = (o[e[s] : e[s + 1]] for o, e in zip((order, pair_order, rare_order), ends, strict=True))
            if not len(own) and not len(own_pairs) and not len(own_rare):
                continue
            new = np.flatnonzero(np.diff(v[own], prepend=-1))
            us, ws = u[own], w[own]
            has[us] = has[ws] = True
            codebook = np.flatnonzero(has)
            has[codebook], rank[codebook] = False, np.arange(len(codebook))
            halves = [half for x in (rank[us], rank[ws]) for half in (x.astype(np.uint16), (x >> 16).astype(np.uint16))]
            k = times[own]
            lists = listed[np.arange(k.sum()) + np.repeat(starts[own] - (np.cumsum(k) - k), k)]
            first = np.flatnonzero(np.diff(rare_word[own_rare], prepend=-1))
            p = pair_of[own_pairs]
            start = np.flatnonzero(np.diff(pair_v[p], prepend=-1))
            yield s, pack(
                *(steps(words[v[own][new]]), np.diff(new, append=len(own)).astype(np.uint32)),
                *(steps(words[rare_word[own_rare][first]]), np.diff(first, append=len(own_rare)).astype(np.uint32), rare_text[own_rare]),
                *(steps(short(words[codebook])), learned[own], k.astype(np.uint32), *halves, lists),
                *(steps(words[pair_v[p][start]]), np.diff(start, append=len(p)).astype(np.uint32), pair_n[p], short(words[pair[p] % m])),
            )


def mapped(trie: Trie) -> Trie:
    """The trie in a nameless file of this task, mapped."""
    with tempfile.TemporaryFile() as f:
        f.write(trie.to_bytes())
        f.flush()
        return Trie.from_buffer(np.memmap(f, np.uint8, mode="r").view(np.ndarray))  # slices of a memmap cost more than those of an array


class Base:
    """The base's probabilities: counts of the frequent words, number of tokens and of distinct ones in training."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.codes, self.logs, self.norm = codes, np.log10(counts + 1.0), float(np.log10(total + distinct + 1))
        order = np.argsort(short(codes), kind="stable")
        self.shorts, self.short_logs = short(codes)[order], self.logs[order]

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are frequent, and log10 of their counts plus one."""
        return self._look(self.codes, self.logs, words)

    def known_short(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._look(self.shorts, self.short_logs, words)

    @staticmethod
    def _look(codes: np.ndarray, logs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(codes):
            return np.zeros(len(words), bool), np.zeros(len(words))
        at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
        hit = codes[at] == words
        return hit, np.where(hit, logs[at], 0.0)


def answers(blobs: list[bytes], base: Base, discount: float) -> Iterator[bytes]:
    """One blob for each that asks this shard, from the trie of what all of them learned."""

    def opened(blob: bytes) -> list[np.ndarray]:
        a = unpack(blob, ASKED)
        for k in (0, 2, 5, 13):
            a[k] = np.cumsum(a[k], dtype=a[k].dtype)
        for k in (1, 3, 14):
            a[k] = a[k].astype(np.int64)
        return a

    asked = [opened(b) for b in blobs]
    joined = lambda k: np.concatenate([a[k] for a in asked])
    number = lambda low, high: low.astype(np.int64) | high.astype(np.int64) << 16
    words = distinct(np.concatenate([joined(5), joined(16)]))
    heads = distinct(np.concatenate([joined(0), joined(13)]))
    places = [np.searchsorted(words, a[5]) for a in asked]
    u, w = (np.concatenate([p[number(a[k], a[k + 1])] for a, p in zip(asked, places, strict=True)]) for k in (8, 10))
    v = np.concatenate([np.repeat(np.searchsorted(heads, a[0]), a[1]) for a in asked])
    del places
    # What several blobs ask is made and looked up once.
    v, u, w, of, _ = distinct_trigrams(v, u, w, max(len(heads), len(words)))
    n = np.bincount(of, joined(6), len(v)).astype(np.int64)
    whole_v, whole_w = np.repeat(np.searchsorted(heads, joined(13)), joined(14)), np.searchsorted(words, joined(16))
    bigrams = merged_bigrams(whole_v, whole_w, joined(15).astype(np.int64))
    had = n > 0
    learned = np.zeros(len(heads), bool)
    learned[v[had]] = learned[bigrams[0]] = True
    top = np.cumsum(learned) - 1
    trie = mapped(Trie.of(heads[learned], words, (top[v[had]], u[had], w[had], n[had]), (top[bigrams[0]], *bigrams[1:]), discount))
    kept = [(a[7], a[12], a[3], a[4]) for a in asked]
    seen = np.split(trie.seen(joined(2)), np.cumsum([len(a[2]) for a in asked])[:-1])
    of = np.split(of.astype(np.int32), np.cumsum([len(a[6]) for a in asked])[:-1])
    del asked, n, had, bigrams, whole_v, whole_w
    new = np.flatnonzero(np.diff(v, prepend=-1))
    value, open_ = trie.score(heads[v[new]], np.diff(new, append=len(v)), words, u, w)
    hit, logs = base.known_short(words)
    value = value + np.where(open_, (logs * hit)[w] - base.norm, 0.0)
    lost, word = open_ & ~hit[w], words[w]
    del v, u, w, open_
    for (k, texts, times, rare), counts, grams in zip(kept, seen, of, strict=True):
        sums, there = np.bincount(texts, np.repeat(value[grams], k)), np.flatnonzero(np.bincount(texts))
        late = np.repeat(lost[grams], k)
        counts = np.repeat(counts, times)
        rare_there = np.flatnonzero(np.bincount(rare))
        yield pack(
            *(there.astype(np.uint16), sums[there].astype(np.float32)),
            *(rare_there.astype(np.uint16), np.bincount(rare, np.log10(counts + 1.0))[rare_there], np.bincount(rare, counts > 0)[rare_there].astype(np.uint32)),
            *(texts[late].astype(np.uint16), np.repeat(word[grams], k)[late]),
        )


def merged_bigrams(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.zeros(0, np.intp)
    return v[new], w[new], np.add.reduceat(n, new) if len(new) else n


def score(docs: DataFrame, train: Column, text_col: str = "text", discount: float = DISCOUNT) -> tuple[DataFrame, int]:
    """docs' columns but the text, with n_tokens, n_known, base_score and score, which replace columns so named; and N.

    The model is learned from the rows for which ``train`` holds.
    """
    spark = docs.sparkSession
    source = docs.select(text_of(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def unigrams(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def leave():
            if held:
                codes, of = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                n = np.bincount(of, np.concatenate([h[1] for h in held])).astype(np.int64)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], ["code", "n"])

        for batch in batches:
            for _, texts in slices(batch.column(0), SLICE):
                held.append(np.unique(tokens(texts)[0], return_counts=True))
                if sum(len(h[0]) for h in held) > GROUP_TOKENS:
                    yield from leave()
        yield from leave()

    counted = source.where("train").select("text").mapInArrow(unigrams, "code bigint, n bigint")
    counts = materialised(counted.groupBy("code").agg(F.sum("n").alias("n")).where(F.col("code") != int(BEGIN)))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = F.col("n") * F.lit(FREQUENT) >= F.lit(total)
    frequent = counts.where(often).toPandas().sort_values("code")  # at most FREQUENT rows
    words, n = frequent.code.to_numpy(np.uint64), frequent.n.to_numpy(np.int64)
    big = n * SPLIT > total
    parts = {int(c): int(-(-k * SPLIT // total)) for c, k in zip(words[big], n[big], strict=True)}
    if (texts := source.where("train").count()) * SPLIT > total:  # each text has a BEGIN
        parts[int(BEGIN)] = int(-(-texts * SPLIT // max(1, total)))
    shards = 1 + total // SHARD_TOKENS
    base = spark.sparkContext.broadcast(Base(words, n, total, distinct))
    asking = Asking(int(shards), words, parts)

    own = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_known", "base_score", "score")]
    kept = [f"_own{i}" for i in range(len(own))]  # no name of the caller's meets one of ours
    whole = docs.select(text_of(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), *(F.col(c).alias(k) for c, k in zip(own, kept, strict=True)))

    def ask(batches):
        model, run = base.value, TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = texts_held = 0

        def leave():
            nonlocal held, size, texts_held, run
            if held:
                rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
                codes, train = np.concatenate([h[1] for h in held]), np.concatenate([h[3] for h in held])
                owner = np.concatenate([h[2] + b for h, b in zip(held, np.cumsum([0, *[len(h[0]) for h in held[:-1]]]).tolist(), strict=True)])
                held = []
                real = codes != BEGIN
                hit, logs = model.known(codes[real])
                per_text = lambda x: pa.array(np.bincount(owner[real], x, rows.num_rows))
                sums = np.bincount(owner[real], minlength=rows.num_rows)
                known = np.bincount(owner[real], hit, rows.num_rows).astype(np.int64)
                for name, x in (("n_tokens", pa.array(sums)), ("n_known", pa.array(known)), ("base", pa.array(np.asarray(per_text(logs)) - sums * model.norm))):
                    rows = rows.append_column(name, x)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_table(rows)
                own_row = (run % asking.shards, 0, sink.getvalue().to_pybytes())
                out = chain([own_row], ((s, 1, b) for s, b in asking.blobs(codes, owner, train)))
                while part := list(islice(out, 16)):
                    yield pa.RecordBatch.from_arrays([pa.array([run] * len(part), pa.int64()), pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[2] for x in part], pa.binary())], ["run", "shard", "kind", "blob"])
                run += 1
            held, size, texts_held = [], 0, 0

        for batch in batches:
            for part, texts in slices(batch.column(0), SLICE):
                for a in range(0, len(texts), GROUP_TEXTS):
                    some = texts[a : a + GROUP_TEXTS]
                    codes, owner = tokens(some)
                    if size + len(codes) > GROUP_TOKENS or texts_held + len(some) > GROUP_TEXTS:
                        yield from leave()
                    # Copies, as parts of a batch would keep the whole of it.
                    rows = batch.select(range(1, batch.num_columns)).take(pa.array(np.arange(part.start + a, part.start + a + len(some))))
                    held.append((pa.RecordBatch.from_arrays([*rows.columns[1:], pa.nulls(len(some))], [*kept, "_"]), codes, owner, np.array(rows.column(0).to_pylist(), bool)))
                    size, texts_held = size + len(codes), texts_held + len(some)
        yield from leave()

    def answer(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        blobs, runs = table.column("blob").to_pylist(), table.column("run").to_pylist()
        asks = [i for i, k in enumerate(kind) if k]
        back = answers([blobs[i] for i in asks], base.value, discount) if asks else iter(())
        for i, b in zip(asks, back, strict=True):
            blobs[i] = b
        return pa.table({"run": pa.array(runs, pa.int64()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        rows = pa.ipc.open_stream(blobs[kind.index(0)]).read_all().drop_columns(["_"])
        n = rows.num_rows
        value, more, known, lost = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), []
        for k, blob in zip(kind, blobs, strict=True):
            if k:
                texts, sums, rare, logs, seen, open_text, open_word = unpack(blob, ANSWERED)
                value[texts] += sums
                more[rare] += logs
                known[rare] += seen
                lost.append((open_text, open_word))
        open_text, open_word = (np.concatenate(x) for x in zip(*lost, strict=True)) if lost else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(open_text, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(open_text.astype(np.intp), minlength=n))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(open_word[order].astype(np.int64)))
        base_score = rows.column("base").to_numpy() + more
        done = {"n_tokens": rows.column("n_tokens"), "n_known": pa.array(rows.column("n_known").to_numpy() + known), "base_score": pa.array(base_score), "value": pa.array(value), "open": lists}
        return pa.table({**{k: rows.column(k) for k in kept}, **done})

    types = {k: whole.schema[k].dataType.simpleString() for k in kept}
    fields = ", ".join([*(f"{k} {t}" for k, t in types.items()), "n_tokens bigint, n_known bigint, base_score double, value double, open array<bigint>"])
    asked = whole.mapInArrow(ask, "run bigint, shard int, kind int, blob binary")
    answered = asked.groupBy("shard").applyInArrow(answer, "run bigint, kind int, blob binary")
    gathered = materialised(answered.groupBy("run").applyInArrow(gather, fields).withColumn("row", F.monotonically_increasing_id()))
    # Rare words that neither context knows: their counts complete the score.
    rare = counts.where(~often).groupBy(F.shiftright("code", 31).alias("word")).agg(F.sum("n").alias("n"))
    late = gathered.select("row", F.explode("open").alias("word")).join(rare, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("late"))
    back = [F.col(k).alias(c) for c, k in zip(own, kept, strict=True)]
    score_ = (F.col("value") + F.coalesce("late", F.lit(0.0))).alias("score")
    return gathered.join(late, "row", "left").select(*back, "n_tokens", "n_known", "base_score", score_), int(total)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out: Column = crc_mod("doc_id", 7) == 2
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    out, total = score(docs, ~F.col("held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
