"""Geometry as SQL expressions over named columns, which Catalyst compiles like any other; products stand for powers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt((({x1}) - ({x2})) * (({x1}) - ({x2})) + (({y1}) - ({y2})) * (({y1}) - ({y2})))"


def box(prefix: str = "") -> tuple[str, str, str, str]:
    """Column names of a box's corners: left, top, right, bottom."""
    return tuple(f"{prefix}{c}" for c in ("x1", "y1", "x2", "y2"))


def overlaps(a: tuple, b: tuple) -> str:
    """Boxes that share a point, edges included."""
    return f"({a[0]} <= {b[2]} and {a[2]} >= {b[0]} and {a[1]} <= {b[3]} and {a[3]} >= {b[1]})"


def contains(outer: tuple, inner: tuple) -> str:
    return f"({inner[0]} >= {outer[0]} and {inner[2]} <= {outer[2]} and {inner[1]} >= {outer[1]} and {inner[3]} <= {outer[3]})"


def inside(x: str, y: str, b: tuple, pad: float = 0) -> str:
    """Point in the box widened by ``pad``, edges included."""
    return f"({x} between {b[0]} - {pad} and {b[2]} + {pad} and {y} between {b[1]} - {pad} and {b[3]} + {pad})"


def grown(b: tuple, by: float) -> tuple:
    return (f"({b[0]} - {by})", f"({b[1]} - {by})", f"({b[2]} + {by})", f"({b[3]} + {by})")


def extent(s: tuple, by: float = 0) -> tuple:
    """The box that a segment spans, widened by ``by``."""
    x1, y1, x2, y2 = s
    return (f"(least({x1}, {x2}) - {by})", f"(least({y1}, {y2}) - {by})", f"(greatest({x1}, {x2}) + {by})", f"(greatest({y1}, {y2}) + {by})")


def iou(a: tuple, b: tuple) -> str:
    """Intersection over union; 0 without a common area."""
    w, h = f"(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}))", f"(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}))"
    area = lambda c: f"({c[2]} - {c[0]}) * ({c[3]} - {c[1]})"
    return f"case when {w} <= 0 or {h} <= 0 then 0D else coalesce(try_divide({w} * {h}, {area(a)} + {area(b)} - {w} * {h}), 0D) end"


def edges_touch(a: tuple, b: tuple, within: float) -> str:
    """Neither box holds the other, and they come within a distance on both axes."""
    return f"(not {contains(a, b)} and not {contains(b, a)} and {overlaps(a, grown(b, within))})"


def width_similar(a: tuple, b: tuple, ratio: float) -> str:
    wa, wb = f"({a[2]} - {a[0]})", f"({b[2]} - {b[0]})"
    return f"({wa} != 0 and {wb} != 0 and try_divide(abs({wa} - {wb}), greatest({wa}, {wb})) <= {ratio})"


def to_segment(px: str, py: str, s: tuple) -> str:
    """Distance of a point to a segment (x1, y1, x2, y2), which may be a point."""
    dx, dy = f"({s[2]} - {s[0]})", f"({s[3]} - {s[1]})"
    t = f"coalesce(greatest(0D, least(1D, try_divide(({px} - {s[0]}) * {dx} + ({py} - {s[1]}) * {dy}, {dx} * {dx} + {dy} * {dy}))), 0D)"
    return distance(px, py, f"{s[0]} + {t} * {dx}", f"{s[1]} + {t} * {dy}")


def crosses(a: tuple, b: tuple) -> str:
    """Segments that cross by the strict orientation test."""
    ccw = lambda p, q, r: f"(({r[1]} - {p[1]}) * ({q[0]} - {p[0]}) > ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    p1, p2, p3, p4 = a[:2], a[2:], b[:2], b[2:]
    return f"({ccw(p1, p3, p4)} != {ccw(p2, p3, p4)} and {ccw(p1, p2, p3)} != {ccw(p1, p2, p4)})"


def sides(b: tuple) -> list[tuple]:
    """The box's sides from the top, clockwise."""
    x1, y1, x2, y2 = b
    return [(x1, y1, x2, y1), (x2, y1, x2, y2), (x2, y2, x1, y2), (x1, y2, x1, y1)]


def hits_box(s: tuple, b: tuple) -> str:
    """A segment with an end in the box or that crosses a side."""
    return f"({inside(s[0], s[1], b)} or {inside(s[2], s[3], b)} or {' or '.join(crosses(s, e) for e in sides(b))})"


def meeting(s: tuple, e: tuple) -> str:
    """struct(x, y) where two segments meet, ends included; null for parallel ones."""
    den = f"(({s[0]} - {s[2]}) * ({e[1]} - {e[3]}) - ({s[1]} - {s[3]}) * ({e[0]} - {e[2]}))"
    t = f"try_divide(({s[0]} - {e[0]}) * ({e[1]} - {e[3]}) - ({s[1]} - {e[1]}) * ({e[0]} - {e[2]}), {den})"
    u = f"(- try_divide(({s[0]} - {s[2]}) * ({s[1]} - {e[1]}) - ({s[1]} - {s[3]}) * ({s[0]} - {e[0]}), {den}))"
    return f"case when abs({den}) >= 1e-10 and {t} between 0 and 1 and {u} between 0 and 1 then struct({s[0]} + {t} * ({s[2]} - {s[0]}) as x, {s[1]} + {t} * ({s[3]} - {s[1]}) as y) end"


#: Side of a grid cell, in distances that the grid is to find; so a point's surroundings touch few cells, and cells hold few points.
GRID = 4


def cell(value: str, within: float) -> Column:
    return F.expr(f"cast(floor(({value}) / {float(GRID * within)}) as bigint)")


def neighbours(x: str, y: str, within: float) -> Column:
    """The grid cells, four at most, in which points nearer than ``within`` may lie; to be exploded on one side of a range join."""
    gx, gy = ([cell(f"{c} {sign} {float(within)}", within) for sign in "-+"] for c in (x, y))
    return F.array_distinct(F.array(*[F.struct(i.alias("gx"), j.alias("gy")) for i in gx for j in gy]))
