"""Registered queries over the scene tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.functions import geometry as g
from wirespan.functions.params import DEFAULT as P
from wirespan.operators import boxes as bx
from wirespan.operators import drawing, fuse, graph, models, objects, search
from wirespan.operators.cover import levels_of, overlapping
from wirespan.plans import oracle
from wirespan.plans.flows import GraphFlow, fuse_flow
from wirespan.sources import images, scene

CLASSES = {0: "signalName", 1: "device", 2: "power", 3: "ground", 4: "deviceName"}

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Register a function of (lines, boxes, signals, spark, sf_dir)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(scene.scene_lines(spark, sf_dir), scene.scene_boxes(spark, sf_dir), scene.scene_signals(spark, sf_dir), spark, sf_dir)

    _queries[f.__name__] = run
    return f


def flow(lines: DataFrame, boxes: DataFrame, signals: DataFrame) -> GraphFlow:
    return GraphFlow(lines, boxes, signals)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def devices_of(boxes: DataFrame) -> DataFrame:
    return boxes.where("kind = 'device'")


@query
def scene_lines(lines, boxes, signals, spark, d):
    return lines


@query
def scene_boxes(lines, boxes, signals, spark, d):
    return boxes


@query
def scene_signals(lines, boxes, signals, spark, d):
    return signals


@query
def box_geometry(lines, boxes, signals, spark, d):
    """Center, area, width and widened corners of boxes."""
    e = P.box_expand
    return boxes.selectExpr("page_id", "box_idx", "kind", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy", "x2 - x1 as width", "(x2 - x1) * (y2 - y1) as area", f"greatest(0D, x1 - {e}) as ex1", f"greatest(0D, y1 - {e}) as ey1", f"x2 + {e} as ex2", f"y2 + {e} as ey2")


def _box_signal(boxes: DataFrame, signals: DataFrame) -> DataFrame:
    return boxes.join(signals.selectExpr("page_id", "sig_idx", *[f"{c} as s{c}" for c in g.box()]), "page_id")


@query
def iou_pairs(lines, boxes, signals, spark, d):
    """Boxes and texts that have a common area: intersection over union, and whether their widths are similar."""
    both = _box_signal(boxes, signals).selectExpr("page_id", "box_idx", "sig_idx", f"{g.iou(g.box(), g.box('s'))} as iou", f"{g.width_similar(g.box(), g.box('s'), P.width_ratio)} as similar")
    return rounded(both.where("iou > 0"), "iou")


@query
def edge_touch_pairs(lines, boxes, signals, spark, d):
    return _box_signal(boxes, signals).where(g.edges_touch(g.box(), g.box("s"), 9 * P.touch)).select("page_id", "box_idx", "sig_idx")


@query
def edge_touch_near(lines, boxes, signals, spark, d):
    """Texts at line ends that touch at the reference distance, each pair both ways."""
    pins = scene.scene_pins(lines).withColumn("box_idx", F.col("sig_idx"))
    return _box_signal(pins.drop("sig_idx"), pins).where(g.edges_touch(g.box(), g.box("s"), P.touch)).select("page_id", "box_idx", "sig_idx")


@query
def box_pair_counts(lines, boxes, signals, spark, d):
    return search.pair_counts(boxes)


@query
def pin_preview(lines, boxes, signals, spark, d):
    """The first 20 lines of each page by score, as the report of links shows rows."""
    return drawing.preview(lines, ["score", "line_idx"]).select("page_id", "place", "line_idx")


@query
def segment_box_hits(lines, boxes, signals, spark, d):
    """Lines that run through boxes, by the strict crossing test."""
    b = boxes.selectExpr("page_id", "kind", "box_idx", *[f"{c} as b{c}" for c in g.box()])
    return lines.join(b, "page_id").where(g.hits_box(g.box(), g.box("b"))).select("page_id", "line_idx", "kind", "box_idx")


@query
def segment_distances(lines, boxes, signals, spark, d):
    """Distance of texts' centers to the lines of their page, up to the reach of a label, with each line's way."""
    s = signals.selectExpr("page_id", "sig_idx", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy")
    both = lines.join(s, "page_id").selectExpr("page_id", "line_idx", "sig_idx", f"{g.to_segment('cx', 'cy', g.box())} as d", "case when abs(x2 - x1) > abs(y2 - y1) * 2 then 'H' when abs(y2 - y1) > abs(x2 - x1) * 2 then 'V' end as way")
    return rounded(both.where(f"d < {P.text_distance}"), "d")


@query
def score_cut(lines, boxes, signals, spark, d):
    """Lines that each flow keeps by score."""
    cuts = F.array(*[F.struct(F.lit(n).alias("flow"), F.lit(v).alias("least")) for n, v in (("graph", P.line_score), ("fuse", P.fuse_line_score), ("cli", P.cli_line_score))])
    kept = lines.select("page_id", "score", F.inline(cuts)).where("score >= least")
    return kept.groupBy("page_id", "flow").agg(F.count("*").alias("n_lines"))


@query
def tile_grid_half_px(lines, boxes, signals, spark, d):
    return images.tile_grid(scene.scene_images(spark, d), P.tile_size, P.tile_overlap)


@query
def tile_grid_128(lines, boxes, signals, spark, d):
    return images.tile_grid(scene.scene_images(spark, d), P.tile_size, P.scan_overlap)


@query
def tile_remap(lines, boxes, signals, spark, d):
    """Lines in the first tile's model coordinates, moved to the picture."""
    tiles = images.tile_grid(scene.scene_images(spark, d), P.tile_size, P.scan_overlap)
    local = lines.withColumn("row", F.lit(0)).withColumn("col", F.expr("line_idx % 2"))
    return rounded(images.to_picture(local, tiles, P.infer_size), *g.box())


@query
def directory_scan(lines, boxes, signals, spark, d):
    """Picture files by suffix in any case; names without folder and suffix."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".jpeg", ".txt", ".pngx")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    files = scene.table(spark, d, "customer").select(F.concat(F.lit("/in/"), "c_name", F.lit("-"), F.col("c_custkey").cast("string"), suffix).alias("path"))
    return images.picture_names(files).select("path", "name")


@query
def page_payload_decode(lines, boxes, signals, spark, d):
    out = images.decode_payload(scene.page_requests(spark, d))
    return out.select("page_id", "page_number", F.decode("content", "utf-8").alias("content"), "error")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    named = objects.name_classes(scene.scene_detections(spark, d), CLASSES)
    return objects.regions(objects.wanted(named), scene.scene_images(spark, d))


@query
def label_filter(lines, boxes, signals, spark, d):
    kept = objects.wanted(objects.name_classes(scene.scene_detections(spark, d), CLASSES))
    return kept.select("page_id", "det_idx", "class_id", "class_name", "confidence")


@query
def roi_clamp(lines, boxes, signals, spark, d):
    return _regions(spark, d).select("page_id", "det_idx", "class_name", "x_min", "y_min", "x_max", "y_max")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    kept = _regions(spark, d)
    return objects.objects(kept, kept.select("page_id", "det_idx", F.col("ocr_text").alias("text")))


@query
def object_boxes(lines, boxes, signals, spark, d):
    """Objects' point lists back to boxes, with stripped texts."""
    return objects.boxes_of(_objects(spark, d))


@query
def page_payload(lines, boxes, signals, spark, d):
    return objects.page_payloads(_objects(spark, d))


@query
def endpoint_pairs(lines, boxes, signals, spark, d):
    return graph.endpoint_pairs(graph.endpoints(lines), P.merge_distance)


@query
def junctions(lines, boxes, signals, spark, d):
    return rounded(graph.junctions(graph.clustered(lines)), "x", "y")


@query
def graph_edges(lines, boxes, signals, spark, d):
    return graph.edges(graph.clustered(lines))


@query
def graph_stats(lines, boxes, signals, spark, d):
    """Lines, junctions and edges of each page."""
    ends = graph.clustered(lines)
    n = ends.groupBy("page_id").agg((F.count("*") / 2).cast("long").alias("n_lines"), F.countDistinct("jid").alias("n_junctions"))
    m = graph.edges(ends).groupBy("page_id").agg(F.count("*").alias("n_edges"))
    return n.join(m, "page_id", "left").fillna(0, ["n_edges"])


@query
def device_names(lines, boxes, signals, spark, d):
    return bx.device_names(devices_of(boxes), signals).fillna(0, ["rule"])


@query
def power_ground_names(lines, boxes, signals, spark, d):
    return bx.power_ground_names(boxes, signals)


@query
def box_merge(lines, boxes, signals, spark, d):
    out = bx.merge_split(scene.split_boxes(spark, d))
    return out.withColumn("merged_from", F.array_join("merged_from", "-"))


@query
def aux_lines(lines, boxes, signals, spark, d):
    return graph.auxiliary_lines(lines, signals, boxes)


@query
def entry_points(lines, boxes, signals, spark, d):
    return rounded(graph.entry_points(graph.junctions(graph.clustered(lines)), boxes, lines), "x", "y")


@query
def graph_rebuilt(lines, boxes, signals, spark, d):
    return flow(lines, boxes, signals).rebuilt


@query
def graph_contracted(lines, boxes, signals, spark, d):
    return flow(lines, boxes, signals).contracted[1]


@query
def contracted_nodes(lines, boxes, signals, spark, d):
    return rounded(flow(lines, boxes, signals).contracted[0], "x", "y")


@query
def paths(lines, boxes, signals, spark, d):
    return flow(lines, boxes, signals).paths.withColumn("path", F.array_join("path", "-"))


def _shown(found: DataFrame) -> DataFrame:
    places = {f"{e}_{c}": F.round(f"{e}_center.{c}", 6) for e in ("from", "to") for c in "xy"}
    return found.withColumns(places).drop("from_center", "to_center").withColumn("path_jids", F.array_join("path_jids", "-"))


@query
def connections(lines, boxes, signals, spark, d):
    return _shown(flow(lines, boxes, signals).connections)


@query
def connection_summary(lines, boxes, signals, spark, d):
    found = flow(lines, boxes, signals).connections
    return found.groupBy("from_type", "to_type").agg(F.count("*").alias("n_connections"), F.countDistinct("page_id").alias("n_pages"), F.count_if(F.col("signal") != "").alias("n_labelled"))


@query
def connections_csv(lines, boxes, signals, spark, d):
    return drawing.csv_rows(flow(lines, boxes, signals).connections, ["signal", "from_device", "to_device"])


@query
def draw_commands(lines, boxes, signals, spark, d):
    f = flow(lines, boxes, signals)
    return drawing.draw_commands(f.lines, f.boxes, f.signals, f.connections, f.contracted[0], f.entries)


@query
def endpoint_match(lines, boxes, signals, spark, d):
    return fuse.match_endpoints(lines, signals)


@query
def line_dedup(lines, boxes, signals, spark, d):
    return fuse.dedup_lines(lines).select("page_id", "line_idx", "score")


@query
def pin_links(lines, boxes, signals, spark, d):
    out = fuse_flow(lines, scene.scene_pins(lines))
    flat = {f"{e}_{c}": F.col(f"{e}_xy.{c}") for e in ("from", "to") for c in "xy"}
    return out.withColumns(flat).drop("from_xy", "to_xy").withColumn("score", F.bround("score", 3))


@query
def suppressed_detections(lines, boxes, signals, spark, d):
    """Detections of a fair confidence that no better one of their class covers."""
    fair = scene.crowded_detections(spark, d).where("confidence >= 0.05")
    return fuse.suppress_overlaps(fair, 0.1).select("page_id", "det_idx", "class_id", "confidence")


@query
def model_objects(lines, boxes, signals, spark, d):
    """Detections of pictures by a table function, from recorded answers."""
    found = models.recorded_objects(scene.scene_images(spark, d), scene.scene_detections(spark, d))
    return objects.name_classes(found, CLASSES)


@query
def model_lines(lines, boxes, signals, spark, d):
    """Lines of tiles by a table function, from the scene's lines that begin in a tile as recorded answers, moved to the picture."""
    tiles = images.tile_grid(scene.scene_images(spark, d), P.tile_size, P.scan_overlap)
    at = tiles.selectExpr("page_id", "row", "col", "x1 as tx1", "y1 as ty1", "x2 as tx2", "y2 as ty2")
    begun = overlapping(lines, at, ("x1", "y1", "x1", "y1"), g.box("t"), levels=levels_of(at, g.box("t"))).where("x1 < tx2 and y1 < ty2")
    local = [f"({c} - t{c[0]}1) * {P.infer_size}D / (t{c[0]}2 - t{c[0]}1) as {c}" for c in g.box()]
    recorded = begun.selectExpr("page_id", "row", "col", "line_idx", *local, "case when cast(round(score * 1000) as int) % 97 != 0 then score end as score")
    found = models.recorded_lines(tiles, recorded).where(F.col("score") >= P.line_score)
    return rounded(images.to_picture(found, tiles, P.infer_size), *g.box())


@query
def model_texts(lines, boxes, signals, spark, d):
    """From regions to objects: a page's regions of texts to a table function, its answers by place, objects in order."""
    kept = _regions(spark, d)
    asked = kept.where("class_name = 'signalName'").withColumn("ocr_text", F.expr("case when (page_id + det_idx) % 5 != 3 then ocr_text end"))
    texts = models.at_places(asked.select("page_id", "det_idx"), models.recorded_texts(asked.select("page_id", "det_idx", "ocr_text")))
    return objects.objects(kept, texts).select("page_id", "obj_idx", "label", "text")


@query
def merged_texts(lines, boxes, signals, spark, d):
    """The texts of boxes that were merged."""
    return bx.merged_texts(bx.merge_split(scene.split_boxes(spark, d)), scene.split_texts(spark, d))


@query
def flow_counts(lines, boxes, signals, spark, d):
    """What each step of the graph flow has made, as the jobs that made it observed."""
    f = flow(lines, boxes, signals)
    f.paths  # noqa: B018  the last step; it asks for all others
    return spark.createDataFrame(sorted(f.counts.items()), "step string, n bigint")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()
