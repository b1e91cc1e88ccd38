"""Joins of boxes that overlap, by a cover of cells of several sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cell sizes in pixels by level; a last level is one cell for all.
SIZES = (256.0, 16384.0)
LAST = len(SIZES)
#: How a pair meets: both at the left's level and the right's, or one of them at the other's coarser level.
SAME, LEFT_FINER, RIGHT_FINER = 0, 1, 2


def _size(level: str) -> str:
    return f"element_at(array({', '.join(f'{s}D' for s in SIZES)}, 0D), {level} + 1)"


def _level(box: tuple) -> str:
    x1, y1, x2, y2 = box
    extent = f"greatest(({x2}) - ({x1}), ({y2}) - ({y1}))"
    return f"case {' '.join(f'when {extent} <= {s}D then {k}' for k, s in enumerate(SIZES))} else {LAST} end"


def _roles(own: tuple[int, ...], coarser: int, others: list[int]) -> str:
    """SQL: the roles of a box of level lv in cells of level k, where the boxes that it may meet have the levels ``others``."""
    same, finer = own
    of = lambda lv, k: [same] * (k in others) + [finer] * any(o < k for o in others) if k == lv else [coarser] * (k in others)
    cases = [f"when lv = {lv} and k = {k} then array({', '.join(map(str, of(lv, k)))})" for lv in range(LAST + 1) for k in range(lv, LAST + 1) if of(lv, k)]
    return f"case {' '.join(cases)} else cast(array() as array<int>) end" if cases else "cast(array() as array<int>)"


def _cells(box: tuple, own: tuple[int, ...], coarser: int | None, others: list[int] | None = None) -> str:
    """SQL: the cells that a box touches, as an array of structs: of its own level, whose cells are as large as it (four
    cells at most), for each role of ``own``; of all coarser levels for the role ``coarser``, if there is one. If the levels
    of ``others`` are known, there are no cells in which it can meet nothing."""
    x1, y1, x2, y2 = box
    along = lambda a, b: f"case when k = {LAST} then array(0L) else sequence(cast(floor({a} / {_size('k')}) as bigint), cast(floor({b} / {_size('k')}) as bigint)) end"
    roles = f"array({', '.join(map(str, own))})" if coarser is None else f"case when k = lv then array({', '.join(map(str, own))}) else array({coarser}) end"
    roles = roles if others is None else _roles(own, coarser, others)
    cell = f"flatten(transform({along(x1, x2)}, gx -> flatten(transform({along(y1, y2)}, gy -> transform({roles}, role -> struct(k, gx, gy, role))))))"
    return f"flatten(transform(array({_level(box)}), lv -> flatten(transform({'array(lv)' if coarser is None else f'sequence(lv, {LAST})'}, k -> {cell}))))"


def levels_of(rows: DataFrame, box: tuple) -> list[int]:
    """The levels that boxes of rows have, by a job over them."""
    return sorted(r[0] for r in rows.selectExpr(f"{_level(box)} as level").distinct().collect())


def overlapping(left: DataFrame, right: DataFrame, left_box: tuple, right_box: tuple, keys: tuple[str, ...] = ("page_id",), levels: list[int] | None = None, left_levels: list[int] | None = None) -> DataFrame:
    """All columns of left and right (other names but for ``keys``) for rows of equal keys whose boxes share a point, once for each pair.

    Boxes are four SQL expressions: left, top, right, bottom. Sizes may be any: two boxes meet in cells of the level of
    the larger one, which are at least as large as it, so a box has few cells. Of the cells in which they meet the one
    with the first common point counts. Boxes with a null edge overlap nothing. Where the left's right and bottom edges
    are its left and top ones, it is points, which are never the larger ones; ``levels`` then tells which levels the
    right's boxes have at most, as levels_of gives them. Other boxes have cells for each level that there could be, unless
    ``levels`` and ``left_levels`` tell which there are.
    """
    points = left_box[:2] == left_box[2:]
    a = left.withColumns({f"_l{i}": F.expr(e) for i, e in enumerate(left_box)}).where("_l0 <= _l2 and _l1 <= _l3")
    b = right.withColumns({f"_r{i}": F.expr(e) for i, e in enumerate(right_box)}).where("_r0 <= _r2 and _r1 <= _r3")
    box = lambda side: tuple(f"_{side}{i}" for i in range(4))
    if points:
        cell = lambda k: f"struct({k} as k, {'0L' if k == LAST else f'cast(floor(_l0 / {SIZES[k]}D) as bigint)'} as gx, {'0L' if k == LAST else f'cast(floor(_l1 / {SIZES[k]}D) as bigint)'} as gy, {SAME} as role)"
        a = a.select("*", F.expr(f"inline(array({', '.join(cell(k) for k in (range(LAST + 1) if levels is None else levels or [LAST]))}))"))
        b = b.select("*", F.expr(f"inline({_cells(box('r'), (SAME,), None)})"))
    else:
        a = a.select("*", F.expr(f"inline({_cells(box('l'), (SAME, RIGHT_FINER), LEFT_FINER, levels)})"))
        b = b.select("*", F.expr(f"inline({_cells(box('r'), (SAME, LEFT_FINER), RIGHT_FINER, left_levels)})"))
    first = lambda i: f"floor(greatest(_l{i}, _r{i}) / {_size('k')})"
    shared = f"_l0 <= _r2 and _r0 <= _l2 and _l1 <= _r3 and _r1 <= _l3 and (k = {LAST} or (gx = {first(0)} and gy = {first(1)}))"
    both = a.join(b, [*keys, "k", "gx", "gy", "role"]).where(shared)
    return both.drop("k", "gx", "gy", "role", *box("l"), *box("r"))
