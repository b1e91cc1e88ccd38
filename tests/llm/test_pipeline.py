"""The whole pipeline against naive stages, one after another, in plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import within_one
from tests.llm.test_near_dedup import brute_classes
from wirespan.llm import language_id

SF = "/root/testdata/sf0.001"


def naive_languages(docs: list[tuple]) -> list[tuple]:
    """Documents (id, text, lang) that some language's contexts of up to three bytes code in fewer bits than the bound."""
    lettered = [(i, language_id.letters(t), lang) for i, t, lang in docs if t and re.search(r"[^\W\d_]", t)]
    contexts: dict = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang in lettered:
        if lang is not None:
            data = b"\0\0\0" + text
            for i in range(3, len(data)):
                for k in range(4):
                    contexts[lang][data[i - k : i]][data[i]] += 1

    def bits(tree, data):
        total = 0.0
        for i in range(3, len(data)):
            for k in range(3, -1, -1):
                seen = tree.get(data[i - k : i])
                if seen is None:
                    continue
                n, distinct = seen["n"], len(seen) - 1
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / (n + distinct))
                    break
                total -= math.log2(distinct / (n + distinct))
            else:
                total += 8.0
        return total

    trees = [{c: {**seen, "n": seen.total()} for c, seen in tree.items()} for tree in contexts.values()]
    kept = {i for i, text, _ in lettered if min(bits(tree, b"\0\0\0" + text) for tree in trees) / len(text) < language_id.MAX_BITS}
    return [d for d in docs if d[0] in kept]


def naive_lines(docs: list[tuple]) -> list[tuple]:
    seen, by_length, out = set(), defaultdict(list), []
    for doc_id, text, lang in sorted(docs):
        left, lines = [], text.split("\n")
        for raw in lines:
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            near = len(line) >= 20 and any(min(n, len(line)) >= 20 and within_one(line, s) for n in range(len(line) - 1, len(line) + 2) for s in by_length[n])
            if not line or not (line in seen or near):
                left.append(raw)
            if line not in seen:
                seen.add(line)
                by_length[len(line)].append(line)
        now = "\n".join(left)
        if len(left) == len(lines) or re.search(r"[^\x20\x09-\x0D]", now):
            out.append((doc_id, now, lang))
    return out


def naive_pieces(docs: list[tuple]) -> set[tuple]:
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    out = set()
    for doc_id, text, _ in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        while at < len(ids):
            length = min(1024, 1 << (len(ids) - at).bit_length() - 1)
            out.add((doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids), length.bit_length() - 1))
            at += length
    return out


def naive(rows: list[tuple]) -> set[tuple]:
    docs = naive_lines(naive_languages(rows))
    classes = brute_classes([d[:2] for d in docs])
    return naive_pieces([d for d in docs if classes[d[0]] == d[0]])


def packed(rows) -> list[tuple]:
    return [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.bucket) for r in rows]


def test_pipeline_against_naive_stages(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    want = naive(rows)
    assert len({r.sequence_id for r in got}) == len(got) == len(want) and {r.offset for r in got} == {0}
    assert set(packed(got)) == want
    assert len({p[0] for p in want}) < len(rows)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, empty and letterless texts go; null languages and ids stay; of repeated rows one row's text stays."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema.simpleString()[7:-1].replace(":", " ")
    english = "the cat sat on the mat and the dog lay by the door of the house"
    rows = [(1, english, "en", "s"), (1, english, "en", "s"), (2, None, "en", "s"), (3, "", None, "s"), (4, "12 34 !!", "en", "s"), (5, english + "\nwhile the others slept in the house", None, None)]
    fields = spark.read.parquet(f"{SF}/documents.parquet").columns
    made = [{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": len(t or "")} for i, t, lang, s in rows]
    made.append({"doc_id": None, "text": "the house of the dog and the door of the cat", "lang": "en", "source": "s", "n_chars": 44})
    spark.createDataFrame([tuple(m[f] for f in fields) for m in made], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {(r.doc_id, r.doc_tokens) for r in got}
    assert sorted(i or -1 for i, _ in whole) == [-1, 1, 5]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
