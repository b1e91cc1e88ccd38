"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two
that n is a sum of (from 1024 up: as many 1024s as fit), longest first. A
sequence is one piece, so no sequence crosses documents and none is padded;
equal lengths form a bucket (numbered by the power of two), and batches are
drawn from one bucket. Pieces are made where a document is read and carry their
bucket: there is no shuffle, and ``write_buckets`` files each bucket apart.

A null text counts as empty and yields the closing id alone. Rows that repeat
an id get sequences of their own; null ids stay null. Sequence ids are unique
and may have gaps. Further columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import read, text_of
from wirespan.llm.memo import Memo, slices

LONGEST = 1024


class ByteBpe:
    """Ids of a byte-level BPE whose pre-tokens never reach from a non-space over a following space."""

    #: Runs of white space of which more than the last is one pre-token, so that a text can't be encoded word by word.
    ENTANGLED = re.compile(r"\s\s(?:\s|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True
        self.memo = Memo(self._words, 96 << 20)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, keys: list[str]) -> list[bytes]:
        """A key is a word with the line end before it, if any; if none, a space goes before it, unless the key begins with one."""
        out: dict[str, bytes] = {}
        plain = [k for k in keys if (k.isprintable() and k[:1] != " " and k) or (k[:1] == "\n" and len(k) > 1 and k[1:].isprintable())]
        for i in range(0, len(plain), 1000):  # one call for many words; each begins at a token with a space or line end
            run = plain[i : i + 1000]
            ids = self._ids(["".join([k if k[0] == "\n" else f" {k}" for k in run])])[0]
            raw, at = ids.tobytes(), (np.flatnonzero(self.opens[ids]) * 4).tolist()
            out |= zip(run, [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], strict=True)
        rest = [k for k in keys if k not in out]
        texts = [k[1:] if k[:1] == " " else k if k[:1] == "\n" else f" {k}" for k in rest]
        out |= zip(rest, [x.tobytes() for x in self._ids(texts)], strict=True)
        return [out[k] for k in keys]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if self.ENTANGLED.search(t)]
        words = [t.replace("\n", " \n").split(" ") for t in texts]
        for i in whole:
            words[i] = []
        for w in words:
            if w:
                w[0] = f" {w[0]}"
        out = self.memo.join(words)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        return out


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path)


def binary_pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths, each a power of two of at most ``longest``, that add up to n."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, close_id: int = 0, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32 bits each), doc_tokens, sequence_id, offset, bucket."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    source = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = pa.int64() if dict(source.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") else pa.string()
    source = source.withColumn("doc_id", F.col("doc_id").cast("bigint" if id_type == pa.int64() else "string"))
    close = np.array([close_id], "<u4").tobytes()

    def pieces(batches):
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            ids = batch.column("doc_id")
            for part, texts in slices(batch.column("text")):
                starts, lengths, blobs, totals, owner = [], [], [], [], []
                for i, raw in enumerate(bpe.encode(texts), part.start):
                    raw += close
                    at, n = 0, len(raw) // 4
                    for length in binary_pieces(n, longest):
                        starts.append(at)
                        lengths.append(length)
                        blobs.append(raw[4 * at : 4 * (at + length)])
                        at += length
                        totals.append(n)
                        owner.append(i)
                columns = [ids.take(pa.array(owner)).cast(id_type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary()), pa.array(totals, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])

    made = source.mapInArrow(pieces, f"doc_id {'bigint' if id_type == pa.int64() else 'string'}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return made.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Files for training, a folder for each bucket."""
    pieces.write.partitionBy("bucket").parquet(path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
