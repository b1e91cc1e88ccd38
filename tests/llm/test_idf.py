"""The IDF of all shingles, below a tenth of the documents too."""

from __future__ import annotations

import math
import random

import numpy as np

from tests.llm.test_near_dedup import frame
from wirespan.llm import near_dedup


def rows_with_passages():
    """Pairs that share a rare half and differ in little, or share a passage of one document in twenty; and others."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(50000)]
    own = lambda k: rng.choices(words, k=k)
    passage = own(80)
    rows = [(i, " ".join(passage + own(17))) for i in range(40)]
    rare = own(80)
    rows += [(100 + i, " ".join(rare + own(8))) for i in range(2)]
    return rows + [(1000 + i, " ".join(own(60))) for i in range(760)]


def test_table_of_frequencies(spark):
    rows = rows_with_passages()
    table = near_dedup.idf_table(frame(spark, rows).select("text"), len(rows), 5)
    _, code, _ = near_dedup.shingles([t for _, t in rows])
    times = np.bincount((code % np.uint64(near_dedup.IDF_BUCKETS)).astype(np.intp), minlength=len(table))
    idf = lambda df: math.log((1 + len(rows)) / (1 + df)) + 1
    assert all(table[b] == round(16 * idf(times[b]) / idf(1)) for b in np.flatnonzero(times).tolist())
    assert near_dedup.idf_table(frame(spark, []).select("text"), 0, 5).max() > 0


def test_a_passage_of_few_documents_is_light(spark):
    """Equal counts of shared shingles: a passage of a twentieth of the documents is lighter than one of two."""
    rows = rows_with_passages()
    _, code, count = near_dedup.shingles([rows[0][1].rsplit(" ", 17)[0], rows[40][1].rsplit(" ", 8)[0]])
    weights = near_dedup.Weights({}, near_dedup.idf_table(frame(spark, rows).select("text"), len(rows), 5))
    weight = weights.of(code, count)
    assert weight[:76].mean() < 0.6 and weight[76:].mean() > 0.9
    before = near_dedup.common_shingles(frame(spark, rows).select("text"), len(rows), 5)
    assert before == {}  # the clamped IDF told them not apart


def test_op1_weighs_all_shingles(spark, tmp_path):
    """Texts that share 100 of 110 shingles, 0.83 alike by count: with 39 others they are less so by weight, with one other still."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50000)]
    own = lambda k: rng.choices(words, k=k)
    passage, rare = own(104), own(104)
    rows = [(i, " ".join(passage + own(10))) for i in range(40)] + [(100 + i, " ".join(rare + own(10))) for i in range(2)]
    rows += [(1000 + i, " ".join(own(60))) for i in range(760)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.op1_near_dedup(spark, str(tmp_path)).collect()}
    assert got[101] == 100 and all(got[i] == i for i in range(40))
    counted = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert counted[101] == 100 and all(counted[i] == 0 for i in range(40))
