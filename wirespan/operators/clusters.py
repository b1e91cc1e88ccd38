"""Clusters of points that lie near each other, page by page, many pages at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wirespan.operators.components import forest

#: Pairs of points held at a time.
PAIRS = 1 << 20


def _witnesses(x: np.ndarray, y: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Points that are near, for pairs of cells whose points begin at ``one`` and ``two`` of ``at``: at least one pair if there is any."""
    near = lambda a, b: np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b])) < within
    found = [(at[:0], at[:0])]
    total = n_one * n_two
    for i in np.flatnonzero(total > PAIRS):  # a block of points at a time, until one pair is near
        b = at[two[i] : two[i] + n_two[i]]
        step = max(1, PAIRS // len(b))
        for begin in range(one[i], one[i] + n_one[i], step):
            a = at[begin : min(begin + step, one[i] + n_one[i])]
            hit = near(a[:, None], b[None, :])
            if hit.any():
                row, column = np.unravel_index(hit.argmax(), hit.shape)
                found.append((a[row : row + 1], b[column : column + 1]))
                break
    small = np.flatnonzero(total <= PAIRS)
    ends = np.cumsum(total[small])
    begin = 0
    while begin < len(small):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS)))
        some = small[begin:end]
        k, width = total[some], np.repeat(n_two[some], total[some])
        i = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        a, b = at[np.repeat(one[some], k) + i // width], at[np.repeat(two[some], k) + i % width]
        hit = near(a, b)
        found.append((a[hit], b[hit]))
        begin = end
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def near_roots(page: np.ndarray, x: np.ndarray, y: np.ndarray, within: float) -> np.ndarray:
    """For each point the first point of its cluster, where points of a page nearer than ``within`` go together.

    Points of one small cell (its diagonal is shorter than ``within``) are one cluster without being compared. Cells up to
    two steps apart are compared point by point, if nothing has joined them so far.
    """
    n = len(x)
    size = within * 0.7
    usable = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    column, row = (np.floor(c[usable] / size).astype(np.int64) for c in (x, y))
    order = np.lexsort((row, column, page[usable]))
    at, column, row = usable[order], column[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(page[at]) != 0) | (np.diff(column) != 0) | (np.diff(row) != 0)])) if len(at) else np.zeros(0, np.int64)
    count = np.diff(new, append=len(at))
    links = [(at[np.repeat(new, count)], at)]
    root, _ = forest(*links[0], n)
    cell_page, cell_column, cell_row = page[at[new]], column[new], row[new]
    width = int(row.max() - row.min()) + 6 if len(at) else 1
    pages, number = np.unique(cell_page, return_inverse=True)
    spread = int(column.max() - column.min()) + 6 if len(at) else 1
    low_column, low_row = (column.min(), row.min()) if len(at) else (0, 0)
    code = (number * spread + (cell_column - low_column)) * width + (cell_row - low_row)  # rises, as cells are sorted
    for dc in range(3):
        for dr in range(-2, 3):
            if (dc, dr) <= (0, 0) or not len(code):
                continue
            wanted = code + dc * width + dr
            other = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            fits = (code[other] == wanted) & (cell_page[other] == cell_page) & (cell_column[other] == cell_column + dc) & (cell_row[other] == cell_row + dr)
            one, two = np.flatnonzero(fits), other[fits]
            apart = root[at[new[one]]] != root[at[new[two]]]
            one, two = one[apart], two[apart]
            a, b = _witnesses(x, y, at, new[one], new[two], count[one], count[two], within)
            if len(a):
                joined, _ = forest(root[a], root[b], n)
                root = joined[root]
    # Roots are least positions only where points come in order; the first point of a cluster names it.
    first = np.full(n, n)
    np.minimum.at(first, root, np.arange(n))
    return first[root]


def _clustered(table: pa.Table, within: float) -> pa.RecordBatch:
    page, point, x, y = (table.column(c).to_numpy() for c in ("page_id", "pi", "x", "y"))
    root = near_roots(page, x, y, within)
    # Clusters of a page are numbered from 0 by their first points; pages come one after another.
    first = root == np.arange(len(root))
    number = np.cumsum(first) - 1
    start = np.flatnonzero(np.diff(page, prepend=page[0] - 1 if len(page) else 0))
    base = np.repeat(number[start], np.diff(start, append=len(page)))
    jid = number[root] - base
    columns = [table.column(c).combine_chunks() for c in ("page_id", "pi", "x", "y")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(jid.astype(np.int32))], ["page_id", "pi", "x", "y", "jid"])


def whole_pages(batches, run):
    """run over tables that hold whole pages, of batches that are sorted by page_id."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        page = table.column("page_id").to_numpy()
        cut = int(np.searchsorted(page, page[-1]))  # the last page may go on
        if cut:
            yield run(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield run(rest)


def clusters_by_page(within: float):
    """For mapInArrow: rows (page_id, pi, x, y) sorted by page and point get jid, the number of their cluster on the page."""
    return lambda batches: whole_pages(batches, lambda table: _clustered(table, within))


def leading_on(a: np.ndarray, b: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which links a-b of nodes can be on a path between two boxes; box has each node's box if it is an entry, else -1.

    Paths end at entries. Other nodes with one link are peeled off, round by round; then parts of the rest that touch one
    box only go, and links between entries of one box.
    """
    n = len(box)
    alive = a != b
    while True:
        degree = np.bincount(a[alive], minlength=n) + np.bincount(b[alive], minlength=n)
        ends = (degree == 1) & (box < 0)
        peeled = alive & (ends[a] | ends[b])
        if not peeled.any():
            break
        alive &= ~peeled
    inner_a, inner_b = box[a] < 0, box[b] < 0
    inside = alive & inner_a & inner_b
    root, _ = forest(a[inside], b[inside], n)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for one, two, touch in ((a, b, alive & inner_a & ~inner_b), (b, a, alive & inner_b & ~inner_a)):
        np.minimum.at(low, root[one[touch]], box[two[touch]])
        np.maximum.at(high, root[one[touch]], box[two[touch]])
    part = root[np.where(inner_a, a, b)]
    return alive & np.where(inner_a | inner_b, low[part] < high[part], box[a] != box[b])


def _stepped(table: pa.Table) -> pa.RecordBatch:
    page, a, b, a_box, b_box = (table.column(c).to_numpy() for c in ("page_id", "a", "b", "a_box", "b_box"))
    number = np.cumsum(np.diff(page, prepend=page[0]) != 0)
    wide = max(a.max(), b.max()) + 1
    names, code = np.unique(np.concatenate([number * wide + a, number * wide + b]), return_inverse=True)
    box = np.full(len(names), -1, np.int64)
    box[code] = np.concatenate([a_box, b_box])
    keep = leading_on(code[: len(a)], code[len(a) :], box)
    both = [np.concatenate([x[keep], y[keep]]) for x, y in ((page, page), (a, b), (b, a), (b_box, a_box))]
    return pa.RecordBatch.from_arrays([pa.array(both[0]), *(pa.array(c.astype(np.int32)) for c in both[1:])], ["page_id", "u", "v", "v_box"])


def steps_by_page(batches):
    """For mapInArrow: links (page_id, a, b, a_box, b_box; boxes -1 where a node is no entry) sorted by page to steps u, v both ways that lead on."""
    return whole_pages(batches, _stepped)
