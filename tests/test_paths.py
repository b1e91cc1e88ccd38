"""Paths between boxes against a search from each entry, and signals that act in turn against a loop over them."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wirespan.functions.params import Params
from wirespan.operators import clusters, graph, search


def naive_paths(entries: dict, links: set, most: int) -> set:
    around: dict = {}
    for p, a, b in links:
        around.setdefault((p, a), set()).add(b)
        around.setdefault((p, b), set()).add(a)
    found = set()

    def walk(page, path, src):
        for v in around.get((page, path[-1]), ()):
            if v in path:
                continue
            dst = entries.get((page, v))
            if dst is not None:
                if dst > src and len(path) < most:
                    found.add((page, src, dst, (*path, v)))
            elif len(path) + 1 < most:
                walk(page, (*path, v), src)

    for (page, jid), gid in entries.items():
        walk(page, (jid,), gid)
    return found


@pytest.mark.parametrize("most", [2, 3, 6, 7])
def test_paths(spark, most):
    rng = random.Random(most)
    entries = {(p, j): j % 4 for p in range(6) for j in rng.sample(range(24), 8)}
    links = {(p, *sorted(rng.sample(range(24), 2))) for p in range(6) for _ in range(30)} | {(1, 3, 3)}
    boxes = spark.createDataFrame([(p, "device", i, 200.0 * i, 0.0, 200.0 * i + 50, 50.0) for p in range(6) for i in range(4)], "page_id bigint, kind string, box_idx int, x1 double, y1 double, x2 double, y2 double")
    entry = spark.createDataFrame([(p, "device", gid, j) for (p, j), gid in entries.items()], "page_id bigint, kind string, box_idx int, jid int")
    rows = spark.createDataFrame(list(links), "page_id bigint, a int, b int")
    got = [(r.page_id, r.from_gid, r.to_gid, tuple(r.path)) for r in search.paths(entry, rows, boxes, Params(max_nodes=most)).collect()]
    wanted = naive_paths(entries, links, most)
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_peeling_keeps_every_link_of_a_path():
    rng = random.Random(3)
    for _ in range(60):
        n = 25
        box = np.array([rng.randrange(3) if rng.random() < 0.3 else -1 for _ in range(n)])
        links = {(0, *sorted(rng.sample(range(n), 2))) for _ in range(26)}
        a, b = (np.array([x[k] for x in sorted(links)]) for k in (1, 2))
        kept = {(int(x), int(y)) for x, y, k in zip(a, b, clusters.leading_on(a, b, box), strict=True) if k}
        found = naive_paths({(0, j): int(g) for j, g in enumerate(box) if g >= 0}, links, n)
        needed = {tuple(sorted(s)) for _, _, _, path in found for s in zip(path[:-1], path[1:], strict=True)}
        assert needed <= kept
    assert not clusters.leading_on(np.array([0, 1, 2, 2]), np.array([1, 2, 3, 4]), np.array([0, -1, -1, -1, -1])).any()


def test_signals_act_in_turn(spark):
    rng = random.Random(8)
    rows = []
    for page in range(20):
        places = {j: (rng.randrange(40) * 1.0, rng.randrange(40) * 1.0, rng.choice("HV")) for j in range(25)}
        rows += [(page, s, j, *places[j]) for s in range(6) for j in places if rng.random() < 0.3]
    gone, wanted = set(), set()
    for page in range(20):
        for s in range(6):
            for way in "HV":
                own = sorted((y if way == "H" else x, j) for p, q, j, x, y, w in rows if (p, q, w) == (page, s, way) and (p, j) not in gone)
                run: list = []
                for v, j in [*own, (1e9, -1)]:
                    if run and v - run[-1][0] >= 10:
                        if len(run) > 1:
                            wanted |= {(page, s, way, k) for _, k in run}
                            gone |= {(page, k) for _, k in run}
                        run = []
                    run.append((v, j))
    found = spark.createDataFrame(rows, "page_id bigint, sig_idx int, jid int, x double, y double, way string")
    got = [(r.page_id, r.sig_idx, r.way, r.jid) for r in graph.chains_in_turn(found).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len({g[1] for g in got}) > 3
