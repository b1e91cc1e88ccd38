"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's leaves hold the ranks of its adjacent pairs, each with its place; an
inner node holds the least of its two children, so the root yields the leftmost
lowest-rank merge. A merge changes three leaves, each with a logarithmic walk
to the root, until no pair can merge. Many words of one size class go through
the steps together, as rows of one array.

The text is normalised and cut as the tokenizer's file says: special tokens,
NFC, lower case, white space dropped, words by its pattern. Nothing reaches
over a space, so words are encoded once and remembered. Decoding puts a space
between tokens, as the tokenizers library does where a file names no decoder.

A null text counts as empty: no ids, and the empty text decoded. Rows stay one
to one, repeated ids and texts too; further columns are kept as they are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import read, text_of
from wirespan.llm.memo import Memo, slices

NONE = np.int64(1) << 62
#: Leaves worked on at a time.
LEAVES = 1 << 17


class WordBpe:
    """A tokenizers file with word ends: special tokens, NFC, lower case, a splitting pattern, byte-level letters, BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [b""] * self.size
        for token, i in [*vocabulary.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = token.encode()
        letters = byte_letters()
        self.first = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + end] for c in letters], np.int64)
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["merges"]]
        left, right, self.made = np.array(merges, np.int64).T.copy()
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order, 0)
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.memo = Memo(self._chunks)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge; a negative id is no symbol."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, little-endian unsigned 32 bits each. A word is not empty."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            classes.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            step = max(1, LEAVES >> bits)
            for a in range(0, len(members), step):
                run = members[a : a + step]
                for i, ids in zip(run, self._merge([words[i] for i in run], bits), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], bits: int) -> list[bytes]:
        n, leaves = len(words), 1 << bits
        sizes = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(leaves) < sizes[:, None]
        symbols = np.full((n, leaves + 1), -1, np.int64)  # the last column stands for what lies beyond a word
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols[:, :leaves][inside] = self.first[raw]
        rows = np.arange(n)
        symbols[rows, sizes - 1] = self.final[raw[np.cumsum(sizes) - 1]]
        after = np.tile(np.arange(1, leaves + 2), (n, 1))
        after[rows, sizes - 1] = leaves
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        rank = self._rank(symbols[:, :leaves], np.take_along_axis(symbols, after[:, :leaves], 1))
        tree[:, leaves:] = np.where(rank < NONE, rank << bits | np.arange(leaves), NONE)
        for level in reversed(range(bits)):
            k = 1 << level
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

        def put(r, at, value):
            node = at + leaves
            tree[r, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while (r := rows[tree[rows, 1] < NONE]).size if bits else False:
            rows = r
            best = tree[r, 1]
            at = best & (leaves - 1)
            gone = after[r, at]
            then, left = after[r, gone], before[r, at]
            symbols[r, at] = self.made[best >> bits]
            symbols[r, gone] = -1
            after[r, at], before[r, then] = then, at
            put(r, gone, NONE)
            rank = self._rank(symbols[r, at], symbols[r, then])
            put(r, at, np.where(rank < NONE, rank << bits | at, NONE))
            has = left >= 0
            r, at, left = r[has], at[has], left[has]
            rank = self._rank(symbols[r, left], symbols[r, at])
            put(r, left, np.where(rank < NONE, rank << bits | left, NONE))
        kept = symbols[:, :leaves] >= 0
        flat = symbols[:, :leaves][kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each piece of text between two spaces."""
        parts: list[list] = []
        words: dict[bytes, int] = {}
        for chunk in chunks:
            found: list = []
            for piece in self.at_special.split(chunk) if "<|" in chunk else (chunk,):
                if piece in self.special:
                    found.append(self.special[piece])
                    continue
                if piece.isascii():
                    piece = piece.lower()
                else:  # each character by itself: no final form of a letter
                    piece = "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])
                found += [words.setdefault(w.encode(), len(words)) for w in self.words.findall(piece)]
            parts.append(found)
        ids = self.merge(list(words))
        return [b"".join([p if isinstance(p, bytes) else ids[p] for p in found]) for found in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.join([t.split(" ") for t in texts])

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, all others from U+0100 on in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of ids (binary, little-endian unsigned 32 bits each) in place of ``into``."""

    def run(batches):
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for part, texts in slices(batch.column(text_at)):
                rest = batch.slice(part.start, len(texts))
                columns = [c for i, c in enumerate(rest.columns) if i != text_at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bpe.encode(texts), pa.binary())], names)

    kept = [c for c in docs.columns if c not in (into, text_col)]
    source = docs.select(*kept, text_of(text_col).alias(text_col))
    text_at, names = len(kept), [*kept, into]
    schema = source.drop(text_col).withColumn(into, F.lit(b"").cast("binary")).schema
    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of the ids; null ids give null."""

    def run(batches):
        bpe = word_bpe(tokenizer)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    source = docs.drop(into)
    ids_at, names = source.columns.index(ids_col), [*source.columns, into]
    return source.mapInArrow(run, source.withColumn(into, F.lit("")).schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return docs.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
