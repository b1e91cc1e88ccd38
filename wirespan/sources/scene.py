"""A deterministic scene of drawings from the star-schema tables: pages of lines, boxes and signals, and model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.sources.tables import merged_in


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the star schema; all that are read here grow with the input."""
    return merged_in(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, line_idx, ends, score: 30 lines a page."""
    h = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as bigint) as k", "(cast(o_orderkey as bigint) * 7919 + cast(o_custkey as bigint) * 104729 + 12345) % 1000003 as h")
    return h.selectExpr(
        "k div 30 as page_id",
        "cast(k % 30 as int) as line_idx",
        "cast((h % 7) * 100 + (h div 7) % (case when k % 5 = 0 then 25 else 7 end) as double) as x1",
        "cast((h div 49) % 7 * 100 + (h div 847) % 7 as double) as y1",
        "cast((h % 7) * 100 + (h div 5929) % 7 + case when k % 2 = 0 then 100 * (1 + (h div 41503) % 4) else 0 end as double) as x2",
        "cast((h div 49) % 7 * 100 + (h div 290521) % 3 + case when k % 2 = 0 then 0 else 100 * (1 + (h div 41503) % 4) end as double) as y2",
        "cast(h % 1000 as double) / 1000D as score",
    )


def scene_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, kind (device, ground, power), box_idx, corners: 3 boxes a page."""
    h = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as k", "(cast(c_custkey as bigint) * 15485863 + cast(c_nationkey as bigint) * 32452843 + 777) % 1000003 as h")
    return h.selectExpr(
        "k div 3 as page_id",
        "case when k % 9 = 8 then (case when h % 2 = 0 then 'ground' else 'power' end) else 'device' end as kind",
        "cast(k % 3 as int) as box_idx",
        "cast(10 + (k % 3) * 250 as double) as x1",
        "cast(30 + (h % 8) * 60 as double) as y1",
        "cast(110 + (k % 3) * 250 as double) as x2",
        "cast(180 + (h % 8) * 60 as double) as y2",
    )


def scene_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, sig_idx, raw_text, corners: texts around the boxes, up to 4 a page."""
    h = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) as k", "(cast(p_partkey as bigint) * 49979687 + cast(p_size as bigint) * 8191 + 99) % 1000003 as h", "concat(p_name, '-', p_partkey) as raw_text")
    h = h.selectExpr("k div 4 as page_id", "cast(k % 4 as int) as sig_idx", "h", "raw_text", "cast(case when h % 6 = 5 then (h div 6) % 2 else (h div 6) % 3 end as int) as box_idx")
    b = scene_boxes(spark, sf_dir).selectExpr("page_id", "box_idx", "x1 as bx1", "y1 as by1", "x2 as bx2", "y2 as by2")
    return h.join(b, ["page_id", "box_idx"]).selectExpr(
        "page_id",
        "sig_idx",
        "raw_text",
        "case h % 6 when 0 then bx1 + 2 when 5 then bx2 + 45 else bx1 + 38 end as x1",
        "case h % 6 when 0 then by1 + 5 when 1 then by1 - 30 when 2 then by1 + 20 when 3 then by1 + 80 when 4 then by2 + 20 else by1 + 70 end as y1",
        "case h % 6 when 0 then bx1 + 26 when 5 then bx2 + 105 else bx1 + 62 end as x2",
        "case h % 6 when 0 then by1 + 17 when 1 then by1 - 18 when 2 then by1 + 32 when 3 then by1 + 92 when 4 then by2 + 32 else by1 + 82 end as y2",
    )


def scene_pins(lines: DataFrame) -> DataFrame:
    """Texts (page_id, sig_idx, raw_text, corners) around both ends of each of a page's lines; texts repeat."""
    ends = lines.selectExpr("page_id", "inline(array(struct(line_idx * 2 as sig_idx, x1 as x, y1 as y), struct(line_idx * 2 + 1 as sig_idx, x2 as x, y2 as y)))")
    return ends.selectExpr("page_id", "sig_idx", "concat('P', (page_id * 7 + sig_idx * 3) % 6) as raw_text", "x - 12 as x1", "y - 6 as y1", "x + 14 as x2", "y + 8 as y2")


def split_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of which some are one box that a drawing splits: page_id, box_idx, corners; 6 a page in two columns."""
    h = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as k", "(cast(c_custkey as bigint) * 15485863 + cast(c_nationkey as bigint) * 32452843 + 777) % 1000003 as h")
    return h.selectExpr(
        "k div 6 as page_id",
        "cast(k % 6 as int) as box_idx",
        "cast((k % 2) * 400 + h % 20 as double) as x1",
        "cast((h div 20) % 7 * 2600 as double) as y1",
        "cast((k % 2) * 400 + h % 20 + 100 + (h div 140) % 70 as double) as x2",
        "cast((h div 20) % 7 * 2600 + 90 + (h div 9800) % 50 as double) as y2",
    )


def scene_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, width, height of a picture for each customer."""
    return table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) as page_id", "cast(60 + c_custkey * 37 % 4000 as int) as width", "cast(60 + c_custkey * 53 % 3000 as int) as height")


def scene_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detector could give: page_id, det_idx, class_id, confidence, box with edges that may leave the picture."""
    h = table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) as k", "(cast(p_partkey as bigint) * 49979687 + cast(p_size as bigint) * 8191 + 99) % 1000003 as h", "p_name")
    return h.selectExpr(
        "k div 10 as page_id",
        "cast(k % 10 as int) as det_idx",
        "cast(h % 6 as int) as class_id",
        "cast(h % 1000 as double) / 1000D as confidence",
        "cast(h % 900 - 50 as double) + 0.75D as x_min",
        "cast((h div 7) % 700 - 40 as double) + 0.5D as y_min",
        "cast(h % 900 - 50 + (h div 11) % 90 as double) + 0.25D as x_max",
        "cast((h div 7) % 700 - 40 + (h div 13) % 60 as double) + 0.9D as y_max",
        "concat('  ', p_name, ' ') as ocr_text",
    )


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, image_data (base64, for odd pages as a data URL), page_number."""
    raw = F.base64(F.concat_ws("-", "c_name", "c_custkey").cast("binary"))
    url = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("data:image/png;base64,"), raw)).otherwise(raw)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("page_id"), url.alias("image_data"), F.lit(1).alias("page_number"))


def crowded_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_detections, 200 to a page, so that many of a class overlap."""
    k = "page_id * 10 + det_idx"
    return scene_detections(spark, sf_dir).selectExpr(f"({k}) div 200 as page_id", f"cast(({k}) % 200 as int) as det_idx", "class_id", "confidence", "x_min", "y_min", "x_max", "y_max")


def split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, box_idx, raw_text of split_boxes: a name, nothing, an unknown one, or none at all."""
    text = "case c_custkey % 4 when 0 then '' when 1 then 'Unknown' when 2 then c_name end as raw_text"
    return table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) div 6 as page_id", "cast(c_custkey % 6 as int) as box_idx", text)
