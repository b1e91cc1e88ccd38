"""Picture sources: payload decoding, folder scans, tile grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_payload(requests: DataFrame) -> DataFrame:
    """requests with ``content`` (binary) of image_data, which may be a data URL, and ``error`` where there is none.

    A null payload gives a null content with an error; nothing is raised.
    """
    data = F.when(F.contains("image_data", F.lit(",")), F.split("image_data", ",")[1]).otherwise(F.col("image_data"))
    content = F.unbase64(data)
    return requests.withColumn("content", content).withColumn("error", F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "undecodable image"))


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content of a folder's .png, .jpg and .jpeg files in any case, not of its subfolders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return picture_names(files).select("path", "name", "content")


def picture_names(files: DataFrame) -> DataFrame:
    """Rows whose path names a picture, with the file's name without folder and suffix."""
    return files.where(F.lower("path").rlike(r"\.(png|jpe?g)$")).withColumn("name", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))


def tile_grid(pictures: DataFrame, tile: int, overlap: float) -> DataFrame:
    """page_id, row, col and the tile's edges in the picture, for tiles of ``tile`` pixels that overlap.

    Starts are cut to whole pixels. Where a side is no longer than the overlap there is no tile.
    """
    stride = tile - overlap
    n = lambda side: F.ceil((F.col(side) - overlap) / F.lit(float(stride))).cast("int")
    grid = pictures.select("page_id", "width", "height", n("height").alias("rows"), n("width").alias("cols")).where("rows > 0 and cols > 0")
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    start = lambda at: F.expr(f"cast({at} * {float(stride)}D as int)")
    out = grid.withColumn("x1", start("col")).withColumn("y1", start("row"))
    return out.select("page_id", "row", "col", "x1", "y1", F.least(F.col("x1") + tile, "width").alias("x2"), F.least(F.col("y1") + tile, "height").alias("y2"))


def to_picture(lines: DataFrame, tiles: DataFrame, infer_size: int) -> DataFrame:
    """Lines in a tile's model coordinates (page_id, row, col, ends) moved to the picture."""
    both = lines.join(tiles.selectExpr("page_id", "row", "col", "x1 as tx", "y1 as ty", "x2 - x1 as tw", "y2 - y1 as th"), ["page_id", "row", "col"])
    moved = [f"{c} * {'tw' if c[0] == 'x' else 'th'} / {infer_size}D + {'tx' if c[0] == 'x' else 'ty'} as {c}" for c in ("x1", "y1", "x2", "y2")]
    return both.selectExpr("page_id", "row", "col", "line_idx", *moved, "score")
