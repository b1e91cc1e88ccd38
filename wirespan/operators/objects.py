"""Detections to objects: label and region filters, texts, boxes of point lists, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions.params import DEFAULT, Params


def name_classes(detections: DataFrame, names: dict[int, str]) -> DataFrame:
    """detections with class_name from a small constant map; unknown ids get null."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return detections.withColumn("class_name", F.try_element_at(F.create_map(*pairs), F.col("class_id")))


def wanted(detections: DataFrame, p: Params = DEFAULT, least: float = 0.05) -> DataFrame:
    return detections.where(F.col("class_name").isin(*p.labels) & (F.col("confidence") >= least))


def regions(detections: DataFrame, pictures: DataFrame) -> DataFrame:
    """Boxes cut to whole pixels; those of texts are clamped to the picture and dropped if nothing is left."""
    out = detections.join(pictures.select("page_id", "width", "height"), "page_id")
    text = F.col("class_name") == "signalName"
    for c, side in (("x_min", "width"), ("y_min", "height"), ("x_max", "width"), ("y_max", "height")):
        whole = F.col(c).cast("int")
        out = out.withColumn(c, F.when(text, F.greatest(F.lit(0), F.least(side, whole))).otherwise(whole))
    return out.where(~text | ((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))))


def stripped(column: str):
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def objects(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, obj_idx, label, points (clockwise from the top left), text; recognised texts first, then the others.

    A text without a recognition (as where the recogniser failed) is left out, others have an empty text.
    """
    points = F.array(*[F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")) for x, y in (("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))])
    shown = boxes.select("page_id", "det_idx", F.col("class_name").alias("label"), points.alias("points"))
    signals = shown.where("label = 'signalName'").join(texts.select("page_id", "det_idx", "text"), ["page_id", "det_idx"])
    others = shown.where("label != 'signalName'").withColumn("text", F.lit(""))
    both = signals.withColumn("part", F.lit(0)).unionByName(others.withColumn("part", F.lit(1)))
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("page_id").orderBy("part", "det_idx")) - 1
    return both.select("page_id", index.alias("obj_idx"), "label", "points", "text")


def boxes_of(objs: DataFrame, least_points: int = 4, also_two: bool = True) -> DataFrame:
    """objects with a point list's box: of two points, or of four at least; others are dropped."""
    n = F.size("points")
    kept = objs.where((n >= least_points) | ((n == 2) if also_two else F.lit(False)))
    at = lambda f, c: f(F.transform("points", lambda q: q[c])).cast("double")
    text = F.when(F.col("label") == "signalName", stripped("text")).otherwise("")
    return kept.select("page_id", "obj_idx", "label", text.alias("raw_text"), at(F.array_min, "x").alias("x1"), at(F.array_min, "y").alias("y1"), at(F.array_max, "x").alias("x2"), at(F.array_max, "y").alias("y2"))


def page_payloads(objs: DataFrame) -> DataFrame:
    """page_id and its objects in order as one JSON text."""
    item = F.struct("obj_idx", F.struct("label", "points", "text").alias("o"))
    rows = objs.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["o"]).alias("objects"))
    return rows.select("page_id", F.to_json(F.struct(F.lit(1).alias("page_number"), "objects")).alias("payload"))
