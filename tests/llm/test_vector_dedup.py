"""Near duplicates of vectors against all pairs, in one shard and in many, and their odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow.dataset as ds
import pytest

from tests.compare import assert_same
from wirespan.llm import vector_dedup as vd

SF = "/root/testdata/sf0.001"
KIND = "vec_id bigint, embedding array<float>, label int, links int, v string"


def naive(rows) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector, label, ...), in their order."""
    good = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links: dict[int, list] = {i: [] for i in range(len(rows))}
    for label, d in {(rows[i][2], len(rows[i][1])) for i in good}:
        at = np.array([i for i in good if (rows[i][2], len(rows[i][1])) == (label, d)])
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= 0.93):
            if a != b:
                links[at[a]].append(at[b])
    out = [None] * len(rows)
    for start in range(len(rows)):
        if out[start] is None:
            todo, group = [start], set()
            while todo:
                v = todo.pop()
                if v not in group:
                    group.add(v)
                    todo += links[v]
            least = min((rows[v][0] for v in group if rows[v][0] is not None), default=None)
            for v in group:
                out[v] = (rows[v][0], len(links[v]), least, rows[v][0] == least)
    return out


def key(row: tuple) -> tuple:
    return tuple(str(c) for c in row)


def compare(spark, rows, **settings) -> list:
    got = vd.near_duplicates(spark.createDataFrame(rows, KIND).repartition(3), **settings).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted(naive(rows), key=key)
    assert {r.audit_recall for r in got} == {1.0}
    return got


def scattered(seed: int, sizes: list[int], spread: float, d: int = 24) -> list[tuple]:
    """Groups of near copies of these sizes, most of one label."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = rng.normal(size=d)
        label = int(rng.integers(0, 6)) // 4
        rows += [(centre + spread * rng.normal(size=d), label) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(i, [float(np.float32(c)) for c in rows[k][0]], rows[k][1], 5, "x") for i, k in enumerate(order)]


@pytest.mark.parametrize("shard", [2048, 64])
def test_groups(spark, shard):
    rows = scattered(1, [1] * 250 + [2] * 60 + [7] * 20 + [60, 250], 0.12)
    rows += [(10_000 + i, *rows[i % 40][1:]) for i in range(200)]  # equal ones
    got = compare(spark, rows, shard=shard)
    assert max(r.n_links for r in got) > 200 and sum(r.n_links > 0 for r in got) > 400


def test_groups_around_the_threshold(spark):
    compare(spark, scattered(2, [40] * 12, 0.27), shard=64)


def test_what_no_clustering_takes_apart(spark):
    base = np.zeros(8)
    base[0] = 1.0
    rows = [(i, [1.0, *(float(np.float32(1e-7 * ((i >> b) & 1))) for b in range(9))], 0, 0, "") for i in range(400)]
    got = compare(spark, rows, shard=64)
    assert {r.n_links for r in got} == {399} and {r.component_id for r in got} == {0}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [2.0, 4.0], 1), (4, [2.0, 4.0], None), (5, None, 0), (6, [], 0), (7, [0.0, -0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0)]
    rows += [(10, [None, 1.0], 0), (11, [1.0, 2.0, 0.0], 0), (None, [1.0, 2.0], 0), (None, None, 0), (1, [1.0, 2.0], 0), (12, [-0.0, 1.0], 2), (13, [0.0, 1.0], 2), (None, [5.0, 1.0], 3), (14, [1e38, 2e38], 4), (15, [1e-38, 2e-38], 4)]
    got = compare(spark, [(*r, 1, "a") for r in rows])
    assert {r.n_links for r in got if r.vec_id in (1, 2)} == {3} and {r.n_links for r in got if r.vec_id in (12, 13, 14, 15)} == {1}


def test_no_rows(spark):
    assert vd.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_doubles_of_any_size(spark):
    rows = [(1, [1e300, 1e-300], 0), (2, [1e-300, 0.0], 0), (3, [0.0, 5e-324], 0)]
    got = vd.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_whole_table(spark):
    assert assert_same(vd.op12_vector_dedup(spark, SF), vd.ORACLE_SQL, SF) == ds.dataset(f"{SF}/embeddings.parquet").count_rows()


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    vec = vd.unit(np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.12], [1.0, -0.5], [0.0, 1.0]]))
    assert vd.pruned(vec, np.array([0]), np.array([[1, 2, 3, 4, -1, 1]]), 4).tolist() == [[1, 3, 4, -1]]


def test_graph_leads_from_the_medoid_to_every_vertex():
    rng = np.random.default_rng(7)
    vec = vd.unit(np.concatenate([rng.normal(size=(500, 16)), rng.normal(size=16) * 3 + 0.05 * rng.normal(size=(300, 16))]))
    lists, medoid = vd.built(vec)
    reached, todo = {medoid}, [medoid]
    while todo:
        for v in lists[todo.pop()]:
            if v >= 0 and v not in reached:
                reached.add(int(v))
                todo.append(int(v))
    assert len(reached) == len(vec) and (lists >= 0).sum(axis=1).max() <= 2 * vd.DEGREE
