"""Covers that know which sizes of boxes there are: the same pairs, from fewer cells."""

import random

import pytest
from pyspark.sql import functions as F

from wirespan.operators import cover


@pytest.mark.parametrize("left_sizes, right_sizes", [((100, 400), (150,)), ((30, 9000, 40000), (30, 9000, 40000)), ((40000,), (30,)), ((30,), (40000,))])
def test_known_levels(spark, left_sizes, right_sizes):
    rng = random.Random(6)

    def boxes(sizes, name):
        rows = [(i % 3, i, x := rng.uniform(-500, 3000), y := rng.uniform(-500, 3000), x + rng.uniform(0, s), y + rng.uniform(0, s)) for i in range(90) for s in [rng.choice(sizes)]]
        return spark.createDataFrame(rows, f"page_id bigint, {name} int, {name}1 double, {name}2 double, {name}3 double, {name}4 double")

    a, b = boxes(left_sizes, "a"), boxes(right_sizes, "b")
    box = lambda s: tuple(f"{s}{i}" for i in range(1, 5))
    levels = {"levels": cover.levels_of(b, box("b")), "left_levels": cover.levels_of(a, box("a"))}
    pairs = lambda df: sorted((r.page_id, r.a, r.b) for r in df.collect())
    wanted = sorted((p.page_id, p.a, q.b) for p in a.collect() for q in b.collect() if p.page_id == q.page_id and p.a1 <= q.b3 and q.b1 <= p.a3 and p.a2 <= q.b4 and q.b2 <= p.a4)
    assert pairs(cover.overlapping(a, b, box("a"), box("b"), **levels)) == pairs(cover.overlapping(a, b, box("a"), box("b"))) == wanted
    cells = lambda known: a.select(F.sum(F.expr(f"size({cover._cells(box('a'), (cover.SAME, cover.RIGHT_FINER), cover.LEFT_FINER, known)})"))).first()[0]
    assert cells(levels["levels"]) < cells(None)
