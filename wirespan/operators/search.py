"""Connections: bounded simple paths between boxes, with the text that labels each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import geometry as g
from wirespan.functions.params import DEFAULT, Params
from wirespan.operators.clusters import steps_by_page
from wirespan.operators.cover import overlapping
from wirespan.operators.graph import KINDS
from wirespan.sources.tables import merged_in, shared_table


def numbered_boxes(boxes: DataFrame) -> DataFrame:
    """boxes with gid: devices, then grounds, then powers of a page, each by index."""
    return boxes.withColumn("gid", F.row_number().over(Window.partitionBy("page_id").orderBy(F.expr(KINDS), "box_idx")) - 1)


def half_paths(owner: DataFrame, step: DataFrame, most: int) -> DataFrame:
    """page_id, gid, at, path: simple ways of at most ``most`` nodes from each entry (page_id, jid, gid) over nodes that are none.

    Each round adds a node to the ways of the last one, over a written table, and ends with the longest way there is.
    """
    found = [shared_table(owner.select("page_id", "gid", F.col("jid").alias("at"), F.array("jid").alias("path")))]
    inner = step.where("v_box < 0").select("page_id", F.col("u").alias("at"), "v")
    for _ in range(most - 1):
        longer = found[-1].join(inner, ["page_id", "at"]).where("not array_contains(path, v)")
        longer = shared_table(longer.select("page_id", "gid", F.col("v").alias("at"), F.array_append("path", F.col("v")).alias("path")))
        if not longer.limit(1).count():
            break
        found.append(longer)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return merged_in(out)


def paths(entries: DataFrame, graph: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, from_gid, to_gid, path: simple paths of at most ``max_nodes`` nodes from one box's entries to a later box's.

    A path ends at the first entry it meets, so its other nodes are none. Dead ends are peeled off at first, and parts of
    the graph that touch one box only. Ways of half the length then lead from all entries at once, and two ways from different boxes make
    a path where an edge joins their ends and they share no node; of a path's nodes the earlier box has as many as the
    later one, or one more. Pairs of boxes that mostly cover each other are left out.
    """
    gids = numbered_boxes(boxes)
    owner = shared_table(entries.select("page_id", "kind", "box_idx", "jid").join(gids.select("page_id", "kind", "box_idx", "gid"), ["page_id", "kind", "box_idx"]).select("page_id", "jid", "gid"))
    at = lambda c: owner.select("page_id", F.col("jid").alias(c), F.col("gid").alias(f"{c}_box"))
    links = graph.where("a != b").select("page_id", "a", "b").join(at("a"), ["page_id", "a"], "left").join(at("b"), ["page_id", "b"], "left").fillna(-1, ["a_box", "b_box"])
    dealt = links.select("page_id", "a", "b", "a_box", "b_box").repartition("page_id").sortWithinPartitions("page_id")
    step = shared_table(dealt.mapInArrow(steps_by_page, "page_id bigint, u int, v int, v_box int"))
    half = half_paths(owner, step, (p.max_nodes + 1) // 2)
    first = half.select("page_id", F.col("gid").alias("from_gid"), F.col("at").alias("u"), F.col("path").alias("first"))
    second = half.select("page_id", F.col("gid").alias("to_gid"), F.col("at").alias("v"), F.col("path").alias("second"))
    # The one size that a half has to have is a part of the key.
    lengths = F.explode(F.array(F.size("second"), F.size("second") + 1))
    joined = first.withColumn("n", F.size("first")).join(step.select("page_id", "u", "v"), ["page_id", "u"]).join(second.withColumn("n", lengths), ["page_id", "v", "n"])
    fits = f"from_gid < to_gid and size(first) + size(second) <= {p.max_nodes} and not arrays_overlap(first, second)"
    found = joined.where(fits).select("page_id", "from_gid", "to_gid", F.concat("first", F.reverse("second")).alias("path"))
    corners = lambda end: gids.selectExpr("page_id", f"gid as {end}_gid", *[f"{c} as {end}_{c}" for c in g.box()])
    apart = f"{g.iou(g.box('from_'), g.box('to_'))} <= {p.max_iou}"
    kept = found.join(corners("from"), ["page_id", "from_gid"]).join(corners("to"), ["page_id", "to_gid"]).where(apart)
    return kept.select("page_id", "from_gid", "to_gid", "path")


def pair_counts(boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, pairs, skipped: pairs of a page's boxes, and how many are left out as they mostly cover each other."""
    gids = numbered_boxes(boxes)
    side = lambda end: gids.selectExpr("page_id", f"gid as {end}_gid", *[f"{c} as {end}_{c}" for c in g.box()])
    both = side("from").join(side("to"), "page_id").where("from_gid < to_gid")
    return both.groupBy("page_id").agg(F.count("*").alias("pairs"), F.count_if(F.expr(f"{g.iou(g.box('from_'), g.box('to_'))} > {p.max_iou}")).alias("skipped"))


def path_signals(found: DataFrame, nodes: DataFrame, signals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, path, signal: the text that a path runs through, else the nearest one above it within reach, else empty."""
    steps = found.select("page_id", "path").distinct().select("page_id", "path", F.posexplode("path").alias("pos", "jid"))
    placed = steps.join(nodes.select("page_id", "jid", "x", "y"), ["page_id", "jid"])
    order = Window.partitionBy("page_id", "path").orderBy("pos")
    segments = placed.select("page_id", "path", "x", "y", F.lead("x").over(order).alias("ex"), F.lead("y").over(order).alias("ey")).where("ex is not null")
    texts = signals.selectExpr("page_id", "sig_idx", "raw_text", "x1 as sx1", "y1 as sy1", "x2 as sx2", "y2 as sy2", "(x1 + x2) / 2 as scx", "(y1 + y2) / 2 as scy")
    segment, box = ("x", "y", "ex", "ey"), g.box("s")
    # A text is above a path if it is above any of its segments, also of those that are out of reach.
    segments = segments.withColumn("lowest", F.max(F.expr("(y + ey) / 2 - 5")).over(Window.partitionBy("page_id", "path")))
    near = overlapping(segments, texts, g.extent(segment, p.text_distance), box)
    seen = near.groupBy("page_id", "path", "sig_idx", "raw_text").agg(
        F.expr(f"bool_or({g.hits_box(segment, box)})").alias("hit"), F.expr(f"min({g.to_segment('scx', 'scy', segment)})").alias("d"), F.expr("bool_or(scy < lowest)").alias("above")
    )
    score = F.expr(f"case when hit then 0D when above and d < {p.text_distance} then d end")
    scored = seen.withColumn("score", score).where("score is not null")
    best = scored.groupBy("page_id", "path").agg(F.min(F.struct("score", "sig_idx", "raw_text")).alias("best"))
    return found.join(best, ["page_id", "path"], "left").withColumn("signal", F.coalesce("best.raw_text", F.lit(""))).drop("best")


def connections(found: DataFrame, nodes: DataFrame, signals: DataFrame, boxes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per path: devices and types at both ends, signal (null at power or ground), entries, their places, path."""
    labelled = path_signals(found, nodes, signals, p)
    gids = numbered_boxes(boxes)
    side = lambda end: gids.selectExpr("page_id", f"gid as {end}_gid", f"raw_text as {end}_device", f"kind as {end}_type")
    out = labelled.join(side("from"), ["page_id", "from_gid"]).join(side("to"), ["page_id", "to_gid"])
    out = out.withColumn("from_entry", F.element_at("path", 1)).withColumn("to_entry", F.element_at("path", -1))
    for end in ("from", "to"):
        at = nodes.select("page_id", F.col("jid").alias(f"{end}_entry"), F.struct("x", "y").alias(f"{end}_center"))
        out = out.join(at, ["page_id", f"{end}_entry"])
    signal = F.when(F.col("from_type").isin("power", "ground") | F.col("to_type").isin("power", "ground"), F.lit(None)).otherwise(F.col("signal"))
    return out.select("page_id", "from_device", "to_device", "from_type", "to_type", signal.alias("signal"), "from_entry", "to_entry", "from_center", "to_center", F.col("path").alias("path_jids"))
