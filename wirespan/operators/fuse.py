"""Lines between texts: endpoint matching, the best line of each pair, suppression of near-equal lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirespan.functions import geometry as g
from wirespan.functions.params import DEFAULT, Params
from wirespan.operators.cover import levels_of, overlapping
from wirespan.operators.graph import endpoints
from wirespan.sources.tables import merged_in, shared_table


def match_endpoints(lines: DataFrame, signals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, pi, sig_idx, method: an end's first box that holds it with padding, else the one with the nearest center."""
    texts = signals.selectExpr("page_id", "sig_idx", "x1 as sx1", "y1 as sy1", "x2 as sx2", "y2 as sy2")
    held = g.inside("x", "y", g.box("s"), p.endpoint_padding)
    away = g.distance("x", "y", "(sx1 + sx2) / 2", "(sy1 + sy2) / 2")
    reach = max(p.endpoint_padding, p.near_box)  # a center within reach is in the box widened by as much
    wide = g.grown(g.box("s"), reach)
    both = overlapping(endpoints(lines), texts, ("x", "y", "x", "y"), wide, levels=levels_of(texts, wide)).where(f"{held} or {away} < {p.near_box}")
    key = F.expr(f"case when {held} then struct(0 as rank, 0D as d, sig_idx) else struct(1 as rank, {away} as d, sig_idx) end")
    best = both.groupBy("page_id", "pi").agg(F.min(key).alias("b"))
    return best.selectExpr("page_id", "pi", "b.sig_idx as sig_idx", "case b.rank when 0 then 'in_box' else 'near_box' end as method")


def pin_links(lines: DataFrame, signals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The best line (score, then order) of each unordered pair of texts whose boxes a line joins."""
    ends = match_endpoints(lines, signals, p).withColumn("line_idx", F.expr("pi div 2"))
    names = signals.select("page_id", "sig_idx", "raw_text")
    side = lambda k, end: ends.where(f"pi % 2 = {k}").join(names, ["page_id", "sig_idx"]).selectExpr("page_id", "line_idx", f"sig_idx as {end}_box", f"method as {end}_method", f"raw_text as `{end}`")
    both = side(0, "from").join(side(1, "to"), ["page_id", "line_idx"]).where("from_box != to_box").join(lines, ["page_id", "line_idx"])
    both = both.withColumn("method", F.concat_ws("+", "from_method", "to_method"))
    pair = [F.least("from", "to").alias("n1"), F.greatest("from", "to").alias("n2")]
    row = F.struct("score", (-F.col("line_idx")).alias("o"), "from", "to", "from_box", "to_box", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("from_xy"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("to_xy"), "method")
    best = both.groupBy("page_id", *pair).agg(F.max_by(row, F.struct("score", -F.col("line_idx"))).alias("r"))
    return best.selectExpr("page_id", "r.`from` as `from`", "r.`to` as `to`", "r.from_box as from_box", "r.to_box as to_box", "r.from_xy as from_xy", "r.to_xy as to_xy", "r.score as score", "r.method as method")


def line_conflicts(lines: DataFrame, within: float) -> DataFrame:
    """page_id, hi, lo: pairs of line ranks (hi before lo) whose ends, either way round, lie nearer than ``within`` on average.

    The middles of such lines are nearer than that too, so lines meet in grid cells of their middles.
    """
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "line_idx"))
    ranked = lines.select("page_id", "line_idx", rank.alias("r"), "x1", "y1", "x2", "y2").withColumn("mx", F.expr("(x1 + x2) / 2")).withColumn("my", F.expr("(y1 + y2) / 2"))
    left = ranked.select("page_id", F.col("r").alias("hi"), *[F.col(c).alias(f"a{c}") for c in g.box()], F.explode(g.neighbours("mx", "my", within)).alias("cell"))
    left = left.select("page_id", "hi", *[f"a{c}" for c in g.box()], "cell.gx", "cell.gy")
    right = ranked.select("page_id", F.col("r").alias("lo"), *g.box(), g.cell("mx", within).alias("gx"), g.cell("my", within).alias("gy"))
    same = f"({g.distance('ax1', 'ay1', 'x1', 'y1')} + {g.distance('ax2', 'ay2', 'x2', 'y2')}) / 2"
    turned = f"({g.distance('ax1', 'ay1', 'x2', 'y2')} + {g.distance('ax2', 'ay2', 'x1', 'y1')}) / 2"
    return left.join(right, ["page_id", "gx", "gy"]).where(f"hi < lo and least({same}, {turned}) < {within}").select("page_id", "hi", "lo")


def dedup_lines(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Lines that no kept line of a better score (ties: earlier) nearly equals."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "line_idx"))
    return survivors(lines.withColumn("r", rank), line_conflicts(lines, p.duplicate_lines))


def suppress_overlaps(detections: DataFrame, max_iou: float = 0.1) -> DataFrame:
    """Detections that no kept one of the page's same class and a better confidence (ties: earlier) covers by more than max_iou (0 at least)."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "det_idx"))
    ranked = detections.withColumn("r", rank)
    corners = ("x_min", "y_min", "x_max", "y_max")
    side = lambda end: ranked.select("page_id", "class_id", F.col("r").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in corners])
    box = lambda end: tuple(f"{end}_{c}" for c in corners)
    met = overlapping(side("hi"), side("lo"), box("hi"), box("lo"), ("page_id", "class_id"))
    pairs = met.where(f"hi < lo and {g.iou(box('hi'), box('lo'))} > {max_iou}")
    return survivors(ranked, pairs.select("page_id", "hi", "lo"))


def survivors(ranked: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Rows (page_id, rank r) that no kept row of a better rank is in conflict with, by pairs (page_id, hi, lo) of ranks.

    In rounds: a row whose better rivals are all dropped is kept, and its other rivals are dropped, until all are decided.
    Only rows that have a rival take part, and every round decides at least the best open one of each page.
    """
    pairs = shared_table(conflicts)
    open_pairs, dropped = pairs, None
    while open_pairs.limit(1).count():
        better = open_pairs.select("page_id", F.col("hi").alias("r")).distinct()
        firm = better.join(open_pairs.select("page_id", F.col("lo").alias("r")).distinct(), ["page_id", "r"], "left_anti")
        gone = shared_table(open_pairs.join(merged_in(firm).withColumnRenamed("r", "hi"), ["page_id", "hi"], "left_semi").select("page_id", F.col("lo").alias("r")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        # A dropped row bars nobody and needs no decision; a firm row's pairs are spent.
        open_pairs = open_pairs.join(gone.withColumnRenamed("r", "lo"), ["page_id", "lo"], "left_anti").join(gone.withColumnRenamed("r", "hi"), ["page_id", "hi"], "left_anti")
        open_pairs = shared_table(open_pairs)
    out = ranked if dropped is None else ranked.join(merged_in(dropped), ["page_id", "r"], "left_anti")
    return out.drop("r")
