"""Boxes: splitting and merging, names from nearby texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions import geometry as g
from wirespan.functions.params import DEFAULT, Params


def merge_split(devices: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """page_id, box_idx (new order), corners, merged_from (old indices; null for a box that was not merged).

    The largest boxes (areas as at the start, ties by index) are tried in turn, at most ``merge_attempts`` a page. The first
    that has similar boxes straight above or below it merges with them all and comes first; one that has none grows for good,
    which later tries see. Pages with one box stay as they are. A page is one array; its tries are a fold over it.
    """
    similar = g.width_similar(g.box("r."), g.box("b."), p.width_ratio)
    close = lambda top, bottom, gap: f"(b.y2 < {top} and {top} - b.y2 <= {gap} or b.y1 > {bottom} and b.y1 - {bottom} <= {gap})"
    aligned = f"b.i != r.i and {similar} and abs((b.x1 + b.x2) / 2 - (r.x1 + r.x2) / 2) <= (r.x2 - r.x1) * {p.center_ratio}"
    near = close("r.y1", "r.y2", p.vertical_gap)
    far = close(f"(r.y1 - {p.vertical_gap})", f"(r.y2 + {p.vertical_gap})", 2 * p.vertical_gap)
    pick = lambda test: f"transform(filter(acc.boxes, b -> exists(array(ref), r -> {aligned} and {test})), b -> b.i)"
    grown = f"transform(acc.boxes, b -> case when b.i = ref.i then named_struct('i', b.i, 'x1', b.x1, 'y1', b.y1 - {p.top_extend}, 'x2', b.x2, 'y2', b.y2 + {p.bottom_extend}) else b end)"
    bound = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"  # noqa: E731  names a value once
    step = bound(
        "ref",
        "filter(acc.boxes, b -> b.i = ranks[k - 1])[0]",
        bound(
            "group",
            f"case when size({pick(near)}) > 0 then {pick(near)} else {pick(far)} end",
            f"case when size(group) > 0 then named_struct('boxes', acc.boxes, 'group', concat(array(ref.i), group)) else named_struct('boxes', {grown}, 'group', cast(array() as array<int>)) end",
        ),
    )
    tries = f"sequence(1, least({p.merge_attempts}, size(boxes)))"
    fold = f"aggregate({tries}, named_struct('boxes', boxes, 'group', cast(array() as array<int>)), (acc, k) -> case when size(acc.group) > 0 or size(boxes) < 2 then acc else {step} end)"
    pages = devices.groupBy("page_id").agg(F.array_sort(F.collect_list(F.expr("named_struct('i', box_idx, 'x1', x1, 'y1', y1, 'x2', x2, 'y2', y2)"))).alias("boxes"))
    pages = pages.withColumn("ranks", F.expr("transform(array_sort(transform(boxes, b -> named_struct('a', -((b.x2 - b.x1) * (b.y2 - b.y1)), 'i', b.i))), z -> z.i)"))
    done = pages.select("page_id", F.expr(fold).alias("f")).selectExpr("page_id", "f.boxes as boxes", "f.group as group")
    chosen = "filter(boxes, b -> array_contains(group, b.i))"
    one = (
        f"named_struct('x1', array_min(transform({chosen}, b -> b.x1)), 'y1', array_min(transform({chosen}, b -> b.y1)) - {p.top_extend}, "
        f"'x2', array_max(transform({chosen}, b -> b.x2)), 'y2', array_max(transform({chosen}, b -> b.y2)) + {p.bottom_extend}, 'merged_from', group)"
    )
    rest = "transform(filter(boxes, b -> not array_contains(group, b.i)), b -> named_struct('x1', b.x1, 'y1', b.y1, 'x2', b.x2, 'y2', b.y2, 'merged_from', cast(null as array<int>)))"
    out = done.selectExpr("page_id", f"posexplode(case when size(group) > 0 then concat(array({one}), {rest}) else {rest} end) as (box_idx, b)")
    return out.selectExpr("page_id", "box_idx", "b.x1 as x1", "b.y1 as y1", "b.x2 as x2", "b.y2 as y2", "b.merged_from as merged_from")


def _with_signals(boxes: DataFrame, signals: DataFrame) -> DataFrame:
    texts = signals.selectExpr("page_id", "sig_idx", "raw_text as sig_text", "x1 as sx1", "y1 as sy1", "x2 as sx2", "y2 as sy2", "(x1 + x2) / 2 as scx", "(y1 + y2) / 2 as scy")
    return boxes.join(texts, "page_id", "left")


def device_names(devices: DataFrame, signals: DataFrame, corner: float = 30, top: float = 50, center: float = 20) -> DataFrame:
    """devices' page_id, box_idx with raw_text and rule: the best text by rule, then distance, then order.

    Rules: 1 in an upper corner, 2 just above the upper edge, 3 just below it, 4 inside and centred, 5 below the box where
    nothing else fits and no text lies inside; else the name is Unknown and the rule null.
    """
    held = g.contains(g.box(), g.box("s"))
    high = f"abs(scy - y1) < {corner * 1.5}"
    left, right = f"({held} and sx2 - x1 < {corner} and {high})", f"({held} and x2 - sx1 < {corner} and {high})"
    level = "scx between x1 - 20 and x2 + 20"
    rule = (
        f"case when {left} or {right} then 1 when sy2 < y1 and {level} and scy between y1 - {top} and y1 then 2 when sy1 > y1 and {level} and scy between y1 and y1 + {top} then 3 "
        f"when {held} and abs(scx - (x1 + x2) / 2) <= {center} then 4 when sy1 > y2 and scx between x1 - 30 and x2 + 30 and scy > y2 and scy <= y2 + 80 then 5 end"
    )
    away = f"case rule when 1 then case when {left} then {g.distance('scx', 'scy', 'x1', 'y1')} else {g.distance('scx', 'scy', 'x2', 'y1')} end when 5 then abs(scy - y2) else abs(scy - y1) end"
    seen = _with_signals(devices, signals).withColumn("rule", F.expr(rule)).withColumn("away", F.expr(away)).withColumn("held", F.expr(f"coalesce({held}, false)"))
    key = F.expr("case when rule is not null then struct(rule, away, sig_idx, sig_text) end")
    out = seen.groupBy("page_id", "box_idx").agg(F.min(key).alias("best"), F.bool_or("held").alias("held"))
    return out.selectExpr("page_id", "box_idx", "case when best.rule < 5 or not held then best.rule end as rule", "case when best is not null and (best.rule < 5 or not held) then best.sig_text else 'Unknown' end as raw_text")


def power_ground_names(boxes: DataFrame, signals: DataFrame, reach: float = 40) -> DataFrame:
    """page_id, kind, box_idx, raw_text of power and ground boxes: the text nearest to the upper or lower edge, else a default."""
    others = boxes.where("kind in ('power', 'ground')")
    away = "least(abs(scy - y1), abs(scy - y2))"
    key = F.expr(f"case when {away} <= {reach} and scx between x1 - 20 and x2 + 20 then struct({away} as away, sig_idx, sig_text) end")
    out = _with_signals(others, signals).groupBy("page_id", "kind", "box_idx").agg(F.min(key).alias("best"))
    return out.selectExpr("page_id", "kind", "box_idx", "coalesce(best.sig_text, case kind when 'power' then 'Power' else 'GND' end) as raw_text")


def named_boxes(boxes: DataFrame, signals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """All boxes with the names that connections show: devices after merging, power and ground by a constant."""
    devices = merge_split(boxes.where("kind = 'device'"), p)
    names = device_names(devices, signals).select("page_id", "box_idx", "raw_text")
    devices = devices.join(names, ["page_id", "box_idx"]).selectExpr("page_id", "'device' as kind", "box_idx", "raw_text", "x1", "y1", "x2", "y2")
    constant = F.when(F.col("kind") == "power", p.power_name).otherwise(p.ground_name)
    others = boxes.where("kind != 'device'").withColumn("raw_text", constant).select(*devices.columns)
    return devices.unionByName(others)


def merged_texts(merged: DataFrame, texts: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """page_id, box_idx, raw_text of boxes that merge_split merged: of the boxes in them (page_id, box_idx, raw_text), in order.

    The first text that is neither empty nor ``unknown`` counts, or else the first box's, where null is ``unknown``.
    """
    parts = merged.where("merged_from is not null").select("page_id", F.col("box_idx").alias("new"), F.posexplode("merged_from").alias("pos", "box_idx"))
    found = parts.join(texts.select("page_id", "box_idx", "raw_text"), ["page_id", "box_idx"], "left")
    told = F.when(F.col("raw_text").isNotNull() & ~F.col("raw_text").isin("", unknown), F.col("pos"))
    text = F.coalesce(F.min_by("raw_text", told), F.min_by(F.coalesce("raw_text", F.lit(unknown)), "pos"))
    return found.groupBy("page_id", F.col("new").alias("box_idx")).agg(text.alias("raw_text"))
