"""Language identification by prediction by partial matching.

For each language a context tree of bytes up to ``ORDER`` before a byte is
counted on training texts and then frozen. A byte's code length is that of its
longest known context; where that context has not seen the byte, an escape is
paid and the next shorter context asked, down to uniform bytes (escapes by
method C: novel symbols share as much as there are distinct ones). A text's
language is the one that codes it shortest; the score is that language's
posterior, 2 to the minus code length, over all languages.

Training takes a bounded sample of labelled texts: at most ``SAMPLE_TEXTS``
texts per language (those with the least hash of their id), each of them whole.
Each prediction reads the whole text. Texts that are null or have no letter are
``und`` with score 0. Case is folded; runs of other than letters count as one
space, so digits, marks and white space carry no vote.

Rows stay one to one, also repeated and tied ones (ties go to the language
that sorts first); null labels aren't learned from; without any training text
everything is ``und``. Further columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirespan.llm.common import crc_mod, read
from wirespan.llm.memo import slices, trimmed

ORDER = 3
SAMPLE_TEXTS = 400
#: Bytes whose code lengths are looked up at a time.
STEP = 1 << 17
#: A text that no language codes in fewer bits a byte than this is in none of them.
MAX_BITS = 8.0
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> bytes:
    """What is scored of a text: its letters in lower case, with single spaces between and around words."""
    return f" {OTHER.sub(' ', text).strip()} ".lower().encode()


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """At each place, the n bytes that end there as one number; fewer at the start, as if zeros came before."""
    out = data.astype(np.uint32)
    for k in range(1, n):
        out[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Models:
    """Frozen context trees of all languages, as tables by n-gram.

    For each order k, ``known[k]`` are the sorted (k + 1)-grams that some language has, ``cost[k]`` their code lengths by
    language from order k down; ``contexts[k]`` and ``escape[k]`` are contexts of k bytes and what leaving each costs.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        n = len(self.languages)
        counts = []
        for language in self.languages:
            data = np.frombuffer(b"\0\0\0".join([b"", *samples[language]]), np.uint8)
            inside = data != 0
            counts.append([np.unique(grams(data, k + 1)[inside], return_counts=True) for k in range(order + 1)])
        self.known, self.cost, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1) if samples else ():
            known = np.unique(np.concatenate([c[k][0] for c in counts]))
            contexts = np.unique(known >> np.uint32(8))
            cost, escape = np.zeros((len(known), n)), np.zeros((len(contexts), n))
            for j, c in enumerate(counts):
                seen, times = c[k]
                context, at = np.unique(seen >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(at, times), np.bincount(at)
                escape[np.searchsorted(contexts, context), j] = np.log2((total + kinds) / kinds)
                here = np.searchsorted(known, seen)
                cost[:, j] = np.nan
                cost[here, j] = np.log2((total + kinds)[at] / times)
            missing = np.isnan(cost)
            if missing.any():  # another language's gram: escape, then the next order's length
                shorter = np.full((len(known), n), 8.0) if k == 0 else self._lengths(known & np.uint32((1 << 8 * k) - 1), k - 1)
                cost = np.where(missing, escape[np.searchsorted(contexts, known >> np.uint32(8))] + shorter, cost)
            self.known.append(known)
            self.cost.append(cost)
            self.contexts.append(contexts)
            self.escape.append(escape)

    def _lengths(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Code lengths by language of bytes whose contexts have k bytes."""
        at = np.minimum(np.searchsorted(self.known[k], gram), len(self.known[k]) - 1)
        out = self.cost[k][at]
        lost = np.flatnonzero(self.known[k][at] != gram)
        if lost.size:
            rest = gram[lost]
            shorter = self._lengths(rest & np.uint32((1 << 8 * k) - 1), k - 1) if k else np.full((lost.size, len(self.languages)), 8.0)
            context = np.minimum(np.searchsorted(self.contexts[k], rest >> np.uint32(8)), len(self.contexts[k]) - 1)
            there = (self.contexts[k][context] == rest >> np.uint32(8))[:, None]
            out[lost] = np.where(there, self.escape[k][context], 0) + shorter
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text by language; a text has one byte at least."""
        gap = b"\0" * self.order
        data = np.frombuffer(gap.join([b"", *texts]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + self.order) - sizes
        gram = grams(data, self.order + 1)
        sums = np.zeros((len(texts), len(self.languages)))
        inside = data != 0
        gram = gram[inside]
        owner = np.repeat(np.arange(len(texts)), sizes)
        for a in range(0, len(gram), STEP):
            b = slice(a, a + STEP)
            lengths, who = self._lengths(gram[b], self.order), owner[b]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            sums[who[first]] += np.add.reduceat(lengths, first)
        assert len(owner) == len(gram) and len(starts) == len(texts)
        return sums


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS) -> Models:
    """Models of a bounded sample of the labelled texts: those of each language with the least hash of their id."""
    order = F.struct(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    texts = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # Ids first, so that only the sample's texts move: the hash below which about twice the wanted number lies.
    sizes = {r[0]: r[1] for r in texts.groupBy(lang_col).count().collect()}
    share = F.lit(0.0)
    for language, n in sizes.items():
        share = F.when(F.col(lang_col) == language, min(1.0, (2 * sample_texts + 50) / n)).otherwise(share)
    near = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share * (1 << 20)
    picked = texts.where(near).select(F.col(lang_col).alias("lang"), order.alias("x"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)).alias("p"))
    ranked = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("p", "x"))).where(F.col("k") <= sample_texts)
    samples: dict[str, list[bytes]] = {}
    for r in ranked.select("lang", F.col("x.text").alias("text")).orderBy("lang", "text").collect():
        samples.setdefault(r.lang, []).append(letters(r.text))
    return Models(samples)


def identify(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (null for ``und``)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches):
        models = shared.value
        for batch in batches:
            for part, texts in slices(batch.column(text_at)):
                n = len(texts)
                lang, score, rate = ["und"] * n, np.zeros(n), np.full(n, np.nan)
                lettered = [i for i, t in enumerate(texts) if LETTER.search(t)] if models.languages else []
                if lettered:
                    data = [letters(texts[i]) for i in lettered]
                    bits = models.bits(data)
                    best = bits.argmin(1)
                    least = bits[np.arange(len(data)), best]
                    score[lettered] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    rate[lettered] = least / np.fromiter(map(len, data), np.int64, len(data))
                    for i, b in zip(lettered, best.tolist(), strict=True):
                        lang[i] = models.languages[b]
                kept = batch.slice(part.start, n).columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], names)

    source = docs.drop("lang_pred", "score", "bits_per_byte")
    text_at, names = source.columns.index(text_col), [*source.columns, "lang_pred", "score", "bits_per_byte"]
    schema = source.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte")).schema
    for field in schema.fields[-3:]:
        field.nullable = True
    return source.mapInArrow(trimmed(run), schema)


def reject_unknown(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The documents in one of the learned languages: not ``und``, and coded in fewer than MAX_BITS bits a byte."""
    judged = identify(docs, models, text_col)
    return judged.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < MAX_BITS)).select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    models = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), models).select("doc_id", "held_out", "lang_pred", "score")
