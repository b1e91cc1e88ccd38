"""Which buckets of a band are held in blocks: those where others than the least vertex span components."""

import numpy as np

from wirespan.llm import fingerprint as fp


def test_buckets_of_two_are_settled(spark):
    rows = [(0, 5, 1), (0, 6, 1), (0, 7, 2), (1, 5, 1), (1, 6, 1)]
    found = fp.open_buckets(spark.createDataFrame(rows, "band bigint, v bigint, component bigint")).collect()
    assert [tuple(r) for r in found] == [(0, 3, 1, 1, 1)]


def test_two_that_share_a_band_do_not_meet_again(spark, monkeypatch):
    counts, judged = [], fp.open_buckets
    monkeypatch.setattr(fp, "open_buckets", lambda at: counts.append((at.count(), judged(at).count())) or judged(at))
    band = np.array_split(np.random.default_rng(8).permutation(fp.SLOTS), fp.SLOTS - 52 + 1)[0]
    other = np.ones(fp.SLOTS, ">u2")
    other[band] = 0
    rows = [(0, bytearray(2 * fp.SLOTS)), (1, bytearray(other.tobytes()))]
    out = fp.with_class(spark.createDataFrame(rows, "doc_id bigint, print binary")).collect()
    assert sorted((r.doc_id, r.class_id) for r in out) == [(0, 0), (1, 1)]
    assert counts == [(1, 0)]
