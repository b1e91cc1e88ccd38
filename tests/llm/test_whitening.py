"""Whitening against numpy's eigenvectors of the exact covariance, and its odd rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow.dataset as ds

from wirespan.llm import whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id bigint, embedding array<float>, label int, component int"


def x_of(vectors) -> list[list[int]]:
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]


def compare(rows, ids, vectors) -> None:
    x = x_of(vectors)
    n, d = len(x), len(x[0])
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for i, r in zip(ids, x, strict=True)}
    y = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    got = {(r.vec_id, r.component): r for r in rows}
    k = min(8, d)
    assert set(got) == {(i, c) for i in ids for c in range(1, k + 1)} and len(rows) == n * k
    wanted = y @ vectors / np.sqrt(values)
    trace = sum(exact.values()) / n**3
    for c in range(k):
        column = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(column @ wanted[:, c])
        assert np.abs(column - sign * wanted[:, c]).max() < 1e-6
        assert abs(got[ids[0], c + 1].explained - values[c] / trace) < 1e-9
    assert all(r.n == n and r.deviation == exact[r.vec_id] and r.identity_error < 1e-9 for r in rows)


def test_whole_table(spark):
    table = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pydict()
    compare(whitening.op11_whitening(spark, SF).collect(), table["vec_id"], table["embedding"])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=3)], None, 7) for i in range(40)]
    bad = [(100, None, 1, 1), (101, [1.0, None, 2.0], 1, 1), (102, [1.0, float("nan"), 2.0], 1, 1), (103, [1.0, float("inf"), 2.0], 1, 1), (104, [], 1, 1), (105, [1.0, 2.0], 1, 1), (106, [1e30, 0.0, 0.0], 1, 1)]
    rows = whitening.whiten(spark.createDataFrame([*good, *bad], KIND)).collect()
    compare(rows, [g[0] for g in good], [g[1] for g in good])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (None, [3.0, -1.0], 0, 0), (4, [0.5, 9.0], 0, 0)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], KIND)
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, 0), (2, [1.0, 2.0], 0, 0)], KIND)
    for rows in (empty, same):
        out = whitening.whiten(rows)
        assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(i) * 2.0**30, 1.0 * i], 0, 0) for i in range(5)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, KIND)).collect()}
    x = x_of([r[1] for r in rows])
    s = [sum(c) for c in zip(*x, strict=True)]
    for i, r in enumerate(x):
        exact = sum((5 * c - t) ** 2 for c, t in zip(r, s, strict=True))
        assert int(got[i].deviation_exact) == exact and got[i].deviation == (exact if exact < 1 << 63 else None)


def test_only_as_many_components_as_the_rank(spark):
    rows = [(i, [1.0 * i, 2.0 * i, -3.0 * i], 0, 0) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 50 and {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
