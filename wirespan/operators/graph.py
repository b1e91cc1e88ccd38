"""Lines to a graph: endpoint clusters, edges, entry points on boxes, splicing and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import geometry as g
from wirespan.functions.params import DEFAULT, Params
from wirespan.operators.clusters import clusters_by_page
from wirespan.operators.components import connected_components
from wirespan.operators.cover import levels_of, overlapping
from wirespan.sources.tables import merged_in, shared_table

KINDS = "case kind when 'device' then 0 when 'ground' then 1 else 2 end"


def endpoints(lines: DataFrame) -> DataFrame:
    """page_id, pi, x, y: a line's ends are points 2i and 2i + 1."""
    return lines.selectExpr("page_id", "inline(array(struct(line_idx * 2 as pi, x1 as x, y1 as y), struct(line_idx * 2 + 1 as pi, x2 as x, y2 as y)))")


def endpoint_pairs(points: DataFrame, within: float) -> DataFrame:
    """page_id, a < b: points nearer than ``within``, by an equi-join on grid cells of that size."""
    left = points.select("page_id", F.col("pi").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(g.neighbours("x", "y", within)).alias("cell"))
    left = left.select("page_id", "a", "ax", "ay", "cell.gx", "cell.gy")
    right = points.select("page_id", F.col("pi").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), g.cell("x", within).alias("gx"), g.cell("y", within).alias("gy"))
    near = F.expr(f"a < b and {g.distance('ax', 'ay', 'bx', 'by')} < {within}")
    return left.join(right, ["page_id", "gx", "gy"]).where(near).select("page_id", "a", "b")


#: Pages with more line ends than this are clustered by links over many tasks, others each in one task's memory.
PAGE_POINTS = 1 << 20


def clustered(lines: DataFrame, p: Params = DEFAULT, page_points: int = PAGE_POINTS) -> DataFrame:
    """page_id, pi, x, y, jid: each end with the junction it belongs to; junctions are numbered by their first end.

    Ends are dealt by page once, and a task clusters many pages at a time. Pages of more than ``page_points`` ends are
    dealt by cells instead.
    """
    points = endpoints(lines)
    large = points.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") > page_points).select("page_id")
    small = points
    if large.limit(1).count():
        large = shared_table(large)
        small = points.join(large, "page_id", "left_anti")
    kind = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    dealt = small.where("page_id is not null").repartition("page_id").sortWithinPartitions("page_id", "pi")
    out = dealt.mapInArrow(clusters_by_page(p.merge_distance), f"page_id {kind['page_id']}, pi {kind['pi']}, x double, y double, jid int")
    return out if small is points else merged_in(out.unionByName(_clustered_by_links(points.join(large, "page_id"), p)))


def _clustered_by_links(points: DataFrame, p: Params) -> DataFrame:
    """The same for pages of any size, by pairs of near ends and their connected components."""
    key = lambda c: F.concat_ws(":", "page_id", F.lpad(F.col(c).cast("string"), 10, "0")).alias(c)  # noqa: E731  sorts as the ends do
    parts = connected_components(endpoint_pairs(points, p.merge_distance).select(key("a"), key("b")))
    end = lambda c: F.substring_index(c, ":", -1).cast("int")
    parts = parts.select(F.substring_index("v", ":", 1).cast("bigint").alias("page_id"), end("v").alias("pi"), end("component").alias("root"))
    rooted = points.join(parts, ["page_id", "pi"], "left").withColumn("root", F.coalesce("root", "pi"))
    order = Window.partitionBy("page_id").orderBy("root")
    return rooted.withColumn("jid", F.dense_rank().over(order) - 1).drop("root")


def junctions(ends: DataFrame) -> DataFrame:
    """page_id, jid, x, y: the mean of a cluster's ends."""
    return ends.groupBy("page_id", "jid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def edges(ends: DataFrame) -> DataFrame:
    """page_id, a < b: distinct pairs of junctions that a line joins."""
    line = ends.groupBy("page_id", F.expr("pi div 2").alias("line_idx")).agg(F.min("jid").alias("a"), F.max("jid").alias("b"))
    return line.where("a != b").select("page_id", "a", "b").distinct()


def entry_points(ends_junctions: DataFrame, boxes: DataFrame, lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, kind, box_idx, line_idx, edge_idx, jid, x, y: where lines meet the sides of widened boxes.

    Entries are numbered after the page's junctions, by kind (device, ground, power), box, line and side.
    """
    e = p.box_expand
    wide = boxes.selectExpr("page_id", "kind", "box_idx", f"greatest(0D, x1 - {e}) as bx1", f"greatest(0D, y1 - {e}) as by1", f"x2 + {e} as bx2", f"y2 + {e} as by2")
    there = levels_of(wide, g.box("b")), levels_of(lines, g.extent(g.box()))
    both = overlapping(lines.select("page_id", "line_idx", "x1", "y1", "x2", "y2"), wide, g.extent(g.box()), g.box("b"), levels=there[0], left_levels=there[1])
    met = ", ".join(g.meeting(g.box(), s) for s in g.sides(g.box("b")))
    found = both.selectExpr("page_id", "kind", "box_idx", "line_idx", f"posexplode(array({met})) as (edge_idx, at)").where("at is not null")
    first = ends_junctions.groupBy("page_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("page_id").orderBy(F.expr(KINDS), "box_idx", "line_idx", "edge_idx")
    numbered = found.withColumn("k", F.row_number().over(order) - 1).join(first, "page_id")
    return numbered.selectExpr("page_id", "kind", "box_idx", "line_idx", "edge_idx", "cast(n + k as int) as jid", "at.x as x", "at.y as y")


def line_ends(lines: DataFrame, nodes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, line_idx, ep1, ep2: the node nearest to a line's start, and to its end if nearer than twice the merge distance.

    Ties go to the lowest node. Both are looked up in grid cells; only starts that have no node within that distance are
    held against all nodes of their page.
    """
    reach = 2 * p.merge_distance
    at = nodes.select("page_id", "jid", F.col("x").alias("nx"), F.col("y").alias("ny"), g.cell("x", reach).alias("gx"), g.cell("y", reach).alias("gy"))
    ends = endpoints(lines)
    near = ends.select("page_id", "pi", "x", "y", F.explode(g.neighbours("x", "y", reach)).alias("cell")).select("page_id", "pi", "x", "y", "cell.gx", "cell.gy")
    d = g.distance("nx", "ny", "x", "y")
    best = F.min(F.struct(F.expr(d).alias("d"), "jid")).alias("best")
    found = near.join(at, ["page_id", "gx", "gy"]).where(f"{d} < {reach}").groupBy("page_id", "pi").agg(best)
    far = ends.where("pi % 2 = 0").join(found, ["page_id", "pi"], "left_anti").join(at, "page_id").groupBy("page_id", "pi").agg(best)
    ids = found.unionByName(far).selectExpr("page_id", "pi div 2 as line_idx", "pi % 2 as which", "best.jid as jid")
    return ids.groupBy("page_id", "line_idx").agg(F.max(F.expr("case when which = 0 then jid end")).alias("ep1"), F.max(F.expr("case when which = 1 then jid end")).alias("ep2"))


def splice(base: DataFrame, entries: DataFrame, nodes: DataFrame, lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, a <= b: base edges with each crossed line's edge replaced by the chain of its entries.

    Lines act in the order of their first entry: each discards the edge between its end nodes and adds its chain. As both
    are idempotent, an edge is there if its last action was to add it.
    """
    crossed = lines.join(entries.select("page_id", "line_idx").distinct(), ["page_id", "line_idx"], "left_semi").select("page_id", "line_idx", "x1", "y1", "x2", "y2")
    crossed = merged_in(crossed)
    ends = line_ends(crossed, nodes, p).where("ep1 is not null and ep2 is not null")
    length = g.distance("x2", "y2", "x1", "y1")
    usable = crossed.join(ends, ["page_id", "line_idx"]).where(f"{length} >= 1e-6")
    along = f"greatest(0D, least(1D, try_divide((x - x1) * try_divide(x2 - x1, {length}) + (y - y1) * try_divide(y2 - y1, {length}), {length})))"
    on = entries.select("page_id", "line_idx", "jid", "x", "y").join(usable, ["page_id", "line_idx"]).withColumn("t", F.expr(along))
    chain = on.groupBy("page_id", "line_idx", "ep1", "ep2").agg(F.min("jid").alias("turn"), F.array_sort(F.collect_list(F.struct("t", "jid"))).alias("es"))
    chain = chain.withColumn("nodes", F.expr("concat(array(ep1), transform(es, e -> e.jid), array(ep2))"))
    steps = F.expr("concat(array(struct(ep1 as u, ep2 as v, 0 as op)), transform(sequence(1, size(nodes) - 1), i -> struct(nodes[i - 1] as u, nodes[i] as v, 1 as op)))")
    log = chain.select("page_id", "turn", F.explode(steps).alias("s")).selectExpr("page_id", "least(s.u, s.v) as a", "greatest(s.u, s.v) as b", "turn", "s.op as op")
    log = base.selectExpr("page_id", "a", "b", "-1 as turn", "1 as op").unionByName(log)
    return log.groupBy("page_id", "a", "b").agg(F.max(F.struct("turn", "op")).alias("last")).where("last.op = 1").select("page_id", "a", "b")


def device_counts(signals: DataFrame, boxes: DataFrame, by: float) -> DataFrame:
    """page_id, sig_idx, n: devices that a signal's box overlaps when widened by ``by``."""
    devices = boxes.where("kind = 'device'").selectExpr("page_id", "x1 as dx1", "y1 as dy1", "x2 as dx2", "y2 as dy2")
    hit = overlapping(signals.select("page_id", "sig_idx", *g.box()), devices, g.grown(g.box(), by), g.box("d"))
    return hit.groupBy("page_id", "sig_idx").agg(F.count("*").alias("n"))


def auxiliary_lines(lines: DataFrame, signals: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, line_idx, ends, score, is_auxiliary: a line through each signal that lies between exactly two devices.

    It runs along the longer side of the widened box; indices go on after the page's lines, in the order of signals.
    """
    e = p.aux_expand
    two = signals.join(device_counts(signals, boxes, e).where("n = 2"), ["page_id", "sig_idx"])
    flat = "x2 - x1 >= y2 - y1"
    order = Window.partitionBy("page_id").orderBy("sig_idx")
    count = lines.groupBy("page_id").agg((F.max("line_idx") + 1).alias("n_lines"))
    out = two.drop("n").join(count, "page_id", "left").withColumn("k", F.row_number().over(order) - 1)
    mid_x, mid_y = f"((x1 - {e}) + (x2 + {e})) / 2", f"((y1 - {e}) + (y2 + {e})) / 2"
    ends = [(f"x1 - {e}", mid_x), (mid_y, f"y1 - {e}"), (f"x2 + {e}", mid_x), (mid_y, f"y2 + {e}")]
    cols = [f"case when {flat} then {h} else {v} end as {c}" for (h, v), c in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)]
    return out.selectExpr("page_id", "cast(coalesce(n_lines, 0) + k as int) as line_idx", *cols, "1D as score", "true as is_auxiliary")


def with_auxiliary(lines: DataFrame, signals: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return lines.withColumn("is_auxiliary", F.lit(False)).unionByName(auxiliary_lines(lines, signals, boxes, p))


def mergeable(nodes: DataFrame, lines: DataFrame, signals: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, sig_idx, jid, x, y, way (H or V): nodes in eligible signals' boxes all of whose lines run one way."""
    skipped = device_counts(signals, boxes, p.contract_expand).where("n = 2")
    eligible = signals.join(skipped, ["page_id", "sig_idx"], "left_anti").selectExpr("page_id", "sig_idx", "x1 as sx1", "y1 as sy1", "x2 as sx2", "y2 as sy2")
    inside = overlapping(nodes.select("page_id", "jid", "x", "y"), eligible, ("x", "y", "x", "y"), g.box("s"), levels=levels_of(signals, g.box())).select("page_id", "sig_idx", "jid", "x", "y")
    reach = p.contract_distance
    flat, steep = "abs(x2 - x1) > abs(y2 - y1) * 2", "abs(y2 - y1) > abs(x2 - x1) * 2"
    way = lines.selectExpr("page_id", "line_idx", f"case when {flat} then 'H' when {steep} then 'V' end as way")
    ends = endpoints(lines).selectExpr("page_id", "pi div 2 as line_idx", "x as ex", "y as ey").join(way, ["page_id", "line_idx"])
    cells = inside.select("page_id", "jid", "x", "y").distinct().select("page_id", "jid", "x", "y", F.explode(g.neighbours("x", "y", reach)).alias("cell"))
    touched = cells.select("page_id", "jid", "x", "y", "cell.gx", "cell.gy").join(ends.withColumn("gx", g.cell("ex", reach)).withColumn("gy", g.cell("ey", reach)), ["page_id", "gx", "gy"])
    touched = touched.where(f"abs(x - ex) < {reach} and abs(y - ey) < {reach}").groupBy("page_id", "jid").agg(F.max("way").alias("hi"), F.min("way").alias("lo"))
    return inside.join(touched.where("hi = lo").selectExpr("page_id", "jid", "hi as way"), ["page_id", "jid"])


def chains(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, sig_idx, way, run, jid, nx, ny: nodes that merge, in runs of at least two, and each run's mean place.

    Along a box's other axis (y for H, x for V) neighbours nearer than twice the contraction distance go together.
    """
    gap = 2 * p.contract_distance
    lane = Window.partitionBy("page_id", "sig_idx", "way").orderBy("v", "jid")
    cut = found.withColumn("v", F.expr("case way when 'H' then y else x end")).withColumn("cut", F.expr("cast(1 as int)") * (F.coalesce(F.col("v") - F.lag("v").over(lane) >= gap, F.lit(True))).cast("int"))
    runs = cut.withColumn("run", F.sum("cut").over(lane))
    group = Window.partitionBy("page_id", "sig_idx", "way", "run")
    runs = runs.withColumn("n", F.count("*").over(group)).where("n > 1").withColumn("nx", F.avg("x").over(group)).withColumn("ny", F.avg("y").over(group))
    return runs.select("page_id", "sig_idx", "way", "run", "jid", "nx", "ny")


def chains_in_turn(found: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """chains of all signals, where they act in order and a node that merged is gone for later ones.

    Signals depend on each other only where a node lies in the boxes of both. In each round those act that no earlier
    signal which is still open shares a node with; of their nodes, what has merged before is left out. So there are as many
    rounds as the longest row of signals that each share a node with the next, and one where boxes share none.
    """
    found = shared_table(found)
    several = found.withColumn("n", F.count("*").over(Window.partitionBy("page_id", "jid"))).where("n > 1")
    before = several.withColumn("earlier", F.lag("sig_idx").over(Window.partitionBy("page_id", "jid").orderBy("sig_idx")))
    waits = shared_table(before.where("earlier is not null").select("page_id", "sig_idx", "earlier").distinct())
    if not waits.limit(1).count():
        return chains(found, p)
    here = ["page_id", "sig_idx"]
    merged, gone, done = None, None, None
    while True:
        later = waits.select(*here).distinct()  # those that wait; the others act now, if they have not yet
        acting = found.join(later, here, "left_anti") if done is None else found.join(later, here, "left_anti").join(done, here, "left_anti")
        if gone is not None:
            acting = acting.join(gone, ["page_id", "jid"], "left_anti")
        new = shared_table(chains(acting, p))
        merged = new if merged is None else merged.union(new)
        gone = merged_in(merged.select("page_id", "jid"))
        if not waits.limit(1).count():
            return merged
        done = merged_in(found.select(*here).distinct().join(later, here, "left_anti"))
        # Signals that acted bar nobody any more; those still open are in ``later``.
        waits = shared_table(waits.join(later.withColumnRenamed("sig_idx", "earlier"), ["page_id", "earlier"], "left_semi").select("page_id", "sig_idx", "earlier"))


def contract(nodes: DataFrame, graph: DataFrame, lines: DataFrame, signals: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the nodes in a signal's box that lie on one track became one new node each.

    Signals act in order, and a node that merged is gone for later ones; with that known it is a relabelling of both ends
    of edges. New nodes are numbered after the page's others by signal, way and run.
    """
    merged = chains_in_turn(mergeable(nodes, lines, signals, boxes, p), p)
    merged = merged.withColumn("seq", F.dense_rank().over(Window.partitionBy("page_id").orderBy("sig_idx", "way", "run")))
    top = nodes.groupBy("page_id").agg(F.max("jid").alias("top"))
    named = merged.join(top, "page_id").selectExpr("page_id", "jid", "cast(top + seq as int) as new_jid", "nx", "ny")
    relabel = merged_in(named.select("page_id", "jid", "new_jid"))
    out = graph
    for end in ("a", "b"):
        out = out.join(relabel.withColumnRenamed("jid", end), ["page_id", end], "left").withColumn(end, F.coalesce("new_jid", end)).drop("new_jid")
    same = out.a == out.b
    loops = graph.where("a = b").join(relabel.withColumnRenamed("jid", "a"), ["page_id", "a"], "left_anti")
    out = out.where(~same).selectExpr("page_id", "least(a, b) as a", "greatest(a, b) as b").unionByName(loops).distinct()
    new = named.select("page_id", F.col("new_jid").alias("jid"), F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
    return nodes.unionByName(new), out
