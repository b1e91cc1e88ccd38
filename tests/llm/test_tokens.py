"""Packing and BPE against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirespan.llm import bpe, packing

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a  b", " lead", "tail ", "Tab\tand\r\nline", "İstanbul ΣΊΣΥΦΟΣ ﬁ", "e\u0301 é", "日本語 한국어", "😀👩‍👩‍👧", "don't I'LL we've", "12345 3.14", "<|endoftext|> x <|startoftext|>y", "x" * 5000, "ab " * 3000, "\u3000wide\u00a0nbsp", "a\x00b\x1c\x85c", "word</w>"]


def odd_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choices("ab cdé\n 1.'’-ß世", k=rng.randint(1, 60))) for _ in range(200)]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_and_decode_like_the_library(spark):
    path, t = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    texts = odd_texts()
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)], "doc_id bigint, text string, decoded string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, repr(x)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False), repr(x)
    assert bpe.encode(docs.limit(0), path).collect() == []


def test_encode_table(spark):
    import hashlib

    t = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.op10_bpe(spark, SF).collect()}
    for i, x in texts.items():
        ids = np.array(t.encode(x, add_special_tokens=False).ids, "<u4")
        assert got[i] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


@pytest.mark.parametrize("longest", [1024, 8])
def test_pieces_are_the_library_ids(spark, longest):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    texts = odd_texts()
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "doc_id bigint, text string, length int")
    pieces = defaultdict(list)
    for r in packing.pack(docs, path, longest=longest).collect():
        pieces[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= longest and r.offset == 0 and len(r.ids) == 4 * r.length
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids, repr(x)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and own[0].doc_tokens == len(ids)
    assert packing.pack(docs.limit(0), path).collect() == []


def test_pack_table(spark):
    t = library("byte_bpe_50k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = packing.op4_packing(spark, SF).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    whole = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    assert all(r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)
    assert sum(r.length for r in got) == sum(map(len, whole.values()))


def test_write_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, None)], "doc_id bigint, text string")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    packing.write_buckets(pieces, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("length")).first()[0] == pieces.agg(F.sum("length")).first()[0]
