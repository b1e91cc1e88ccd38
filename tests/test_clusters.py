"""Clusters of near points against a search from each point, and joins by covers against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from wirespan.operators import clusters
from wirespan.operators.cover import levels_of, overlapping


def naive(page, x, y, within):
    near = (page[:, None] == page[None]) & (np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) < within)
    found = np.full(len(x), -1)
    for start in range(len(x)):
        todo = [start] if found[start] < 0 else []
        while todo:
            v = todo.pop()
            if found[v] < 0:
                found[v] = start
                todo += np.flatnonzero(near[v]).tolist()
    return found


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_near_points(monkeypatch, pairs):
    monkeypatch.setattr(clusters, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    for k in range(25):
        n = int(rng.integers(1, 200))
        page = np.sort(rng.integers(-2, 3, n))
        x, y = (rng.integers(-70, 90, n) * (1.0 if k % 2 else 0.5) for _ in range(2))
        x[n // 2] = np.nan if k % 3 == 0 else np.inf
        assert (clusters.near_roots(page, x, y, 13.0) == naive(page, x, y, 13.0)).all()


def test_many_points_in_one_place():
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 30, (2, 200_000))
    assert not clusters.near_roots(np.zeros(200_000, int), x, y, 13.0).any()


def test_pages_that_span_batches():
    rng = np.random.default_rng(3)
    page = np.sort(rng.integers(0, 9, 300))
    x, y = (rng.integers(0, 120, 300).astype(float) for _ in range(2))
    table = pa.table({"page_id": page, "pi": np.arange(300), "x": x, "y": y})
    out = {}
    for size in (1, 7, 50, 300):
        parts = list(clusters.clusters_by_page(13.0)(iter(table.to_batches(max_chunksize=size))))
        out[size] = [(r["page_id"], r["pi"], r["jid"]) for b in parts for r in b.to_pylist()]
    assert len(out[300]) == 300 and all(v == out[300] for v in out.values())
    roots = naive(page, x, y, 13.0)
    for p in range(9):
        own = [i for i in range(300) if page[i] == p]
        names = sorted({roots[i] for i in own})
        assert [j for q, _, j in out[300] if q == p] == [names.index(roots[i]) for i in own]
    assert list(clusters.clusters_by_page(13.0)(iter([]))) == []


def random_boxes(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.randrange(-2000, 2000), rng.randrange(-900, 900), rng.choice((0, 0, 3, 64, 65, 700, 1024, 20_000, 300_000)), rng.choice((0, 5, 64, 1024, 3000))
        rows.append((rng.randrange(3), i, float(x), float(y), float(x + w), float(y + h)))
    return [*rows, (0, n, None, 1.0, 2.0, 3.0), (0, n + 1, 0.0, 0.0, float("inf"), 0.0), (None, n + 2, 0.0, 0.0, 9.0, 9.0)]


def test_overlapping_boxes(spark):
    kind = "page_id bigint, {0} int, {0}1 double, {0}2 double, {0}3 double, {0}4 double"
    left, right = random_boxes(1, 300), random_boxes(2, 200)
    box = lambda c: tuple(f"{c}{k}" for k in (1, 2, 3, 4))
    a, b = spark.createDataFrame(left, kind.format("a")), spark.createDataFrame(right, kind.format("b"))
    got = [(r.page_id, r.a, r.b) for r in overlapping(a, b, box("a"), box("b")).collect()]
    meets = lambda p, q: p[0] == q[0] and None not in p and None not in q and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]
    wanted = {(p[0], p[1], q[1]) for p in left for q in right if meets(p, q)}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 1000


def test_points_in_boxes(spark):
    left, right = [(*r[:4], *r[2:4]) for r in random_boxes(3, 400)], random_boxes(4, 150)
    a = spark.createDataFrame(left, "page_id bigint, a int, x double, y double, u double, v double").drop("u", "v")
    b = spark.createDataFrame(right, "page_id bigint, b int, b1 double, b2 double, b3 double, b4 double")
    box = ("b1", "b2", "b3", "b4")
    got = [(r.page_id, r.a, r.b) for r in overlapping(a, b, ("x", "y", "x", "y"), box).collect()]
    assert sorted(got) == sorted((r.page_id, r.a, r.b) for r in overlapping(a, b, ("x", "y", "x", "y"), box, levels=levels_of(b, box)).collect())
    assert levels_of(b, box) == [0, 1, 2] and levels_of(b.where("b3 - b1 < 5 and b4 - b2 < 5"), box) == [0]
    inside = lambda p, q: p[0] is not None and p[0] == q[0] and None not in p and None not in q and q[2] <= p[2] <= q[4] and q[3] <= p[3] <= q[5]
    wanted = {(p[0], p[1], q[1]) for p in left for q in right if inside(p, q)}
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 300


def test_a_page_of_many_lines(spark):
    """50,000 lines and 20,000 boxes of one page: the join makes few more rows than pairs."""
    lines = spark.range(50_000).selectExpr("1 as page_id", "id as line", "cast(id % 250 * 200 as double) as x", "cast(id div 250 * 200 as double) as y")
    boxes = spark.range(20_000).selectExpr("1 as page_id", "id as box", "cast(id % 200 * 250 as double) as bx", "cast(id div 200 * 400 as double) as by")
    found = overlapping(lines, boxes, ("x", "y", "x + 150", "y"), ("bx", "by", "bx + 100", "by + 100"))
    n = found.count()
    assert 5_000 < n < 60_000
    assert found.select("line", "box").distinct().count() == n
