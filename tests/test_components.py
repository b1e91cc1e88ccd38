"""Connected components against a search from each vertex, at sizes below and above what one task joins."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from wirespan.operators import components


def naive(links) -> dict:
    around: dict = {}
    for a, b in links:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    found: dict = {}
    for start in sorted(around):
        if start in found:
            continue
        todo = [start]
        while todo:
            v = todo.pop()
            if v not in found:
                found[v] = start
                todo += around[v]
    return found


def random_links(seed: int, vertices: int, n: int, name=int) -> list:
    rng = random.Random(seed)
    return [(name(rng.randrange(vertices)), name(rng.randrange(vertices))) for _ in range(n)]


@pytest.mark.parametrize("small", [1 << 16, 4])
@pytest.mark.parametrize("name", [int, lambda i: f"v{i:04d}"])
def test_components(spark, monkeypatch, small, name):
    monkeypatch.setattr(components, "SMALL", small)
    links = random_links(1, 400, 330, name) + [(name(i), name(i + 1)) for i in range(500, 900)] + [(name(950), name(950))]
    kind = "bigint" if name is int else "string"
    rows = spark.createDataFrame([*links, (None, name(3)), (name(3), None)], f"a {kind}, b {kind}").repartition(7)
    got = components.connected_components(rows).collect()
    wanted = naive(links)
    assert len(got) == len(wanted) and {r.v: r.component for r in got} == wanted


def test_forests_leave_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(components, "SLICE", 64)
    links = random_links(2, 1000, 3000)
    batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in links[i : i + 500]]) for k in (0, 1)], ["root", "v"]) for i in range(0, 3000, 500)]
    out = list(components._forests(iter(batches)))
    assert len(out) > 1 and max(len(b) for b in out) <= 4 * 64
    rest = [(r["root"], r["v"]) for b in out for r in b.to_pylist()]
    assert naive(rest) == naive(links)


def test_forest_has_as_many_links_as_it_joins():
    links = np.array(random_links(3, 300, 250))
    root, used = components.forest(links[:, 0], links[:, 1], 300)
    wanted = naive(links.tolist())
    assert all(root[v] == wanted.get(v, v) for v in range(300))
    assert len(used) == 300 - len(set(root.tolist())) and naive([*links[used].tolist(), *((v, v) for v in wanted)]) == wanted
