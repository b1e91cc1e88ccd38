"""Sinks: result rows as CSV, JSON and draw commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOM = "\ufeff"


def csv_field(column: str):
    """A field as Python's csv module writes it: quoted only if it must be, null as empty."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("page_id", F.concat_ws(",", *[csv_field(c) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, columns: dict[str, str], path: str) -> None:
    """A folder for each page_id with one CSV file that begins with a byte order mark and a header of ``columns``' values.

    Pages that rows have replace their folders when the job is done; a job that fails changes nothing, and other pages stay.
    """
    header = rows.select("page_id").distinct().withColumn("line", F.lit(BOM + ",".join(columns.values()))).withColumn("body", F.lit(False))
    both = header.unionByName(csv_rows(rows, list(columns)).withColumn("body", F.lit(True)))
    both.repartition("page_id").sortWithinPartitions("page_id", "body").select("page_id", "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("page_id").text(path)


def preview(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows of each page, as a report shows them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*order))).where(F.col("place") <= n)


def write_json(rows: DataFrame, columns: list[str], path: str) -> None:
    """JSON lines for each page_id, nulls written; pages are replaced as by write_csv."""
    rows.select("page_id", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("page_id").json(path)


def draw_commands(lines: DataFrame, boxes: DataFrame, signals: DataFrame, connections: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, z, shape, x1, y1, x2, y2, color, text: what a picture of the result shows, from the bottom up.

    Whole pixels; a connection shows each step of its path and, at its middle node, its signal or a question mark.
    """
    at = lambda *cs: [F.col(c).cast("int").alias(n) for c, n in zip(cs, ("x1", "y1", "x2", "y2"), strict=True)]
    shape = lambda df, z, kind, cs, color, text: df.select("page_id", F.lit(z).alias("z"), F.lit(kind).alias("shape"), *at(*cs), color.alias("color"), text.alias("text"))
    none = F.lit("")
    corners = ("x1", "y1", "x2", "y2")
    box_color = F.when(F.col("kind") == "device", "blue").when(F.col("kind") == "ground", "green").otherwise("red")
    entry_color = F.when(F.col("kind") == "device", "cyan").when(F.col("kind") == "ground", "yellow").otherwise("magenta")
    steps = connections.select("page_id", "path_jids", "signal", F.posexplode("path_jids").alias("pos", "jid")).join(nodes.select("page_id", "jid", "x", "y"), ["page_id", "jid"])
    order = Window.partitionBy("page_id", "path_jids").orderBy("pos")
    steps = steps.withColumn("ex", F.lead("x").over(order)).withColumn("ey", F.lead("y").over(order))
    # Both shapes of a step from one row, as two uses of the steps would find all connections twice.
    drawn = lambda z, kind, cs, text: F.struct(F.lit(z).alias("z"), F.lit(kind).alias("shape"), *at(*cs), F.lit("red").alias("color"), text.alias("text"))
    segment = F.when(F.col("ex").isNotNull(), drawn(4, "line", ("x", "y", "ex", "ey"), none))
    middle = F.when(F.expr("pos = size(path_jids) div 2"), drawn(5, "text", ("x", "y", "x", "y"), F.coalesce(F.nullif("signal", F.lit("")), F.lit("?"))))
    parts = [
        shape(lines, 0, "line", corners, F.lit("purple"), none),
        shape(signals, 1, "box", corners, F.lit("orange"), F.col("raw_text")),
        shape(boxes, 2, "box", corners, box_color, F.col("raw_text")),
        shape(entries, 3, "dot", ("x", "y", "x", "y"), entry_color, none),
        steps.select("page_id", F.inline(F.array_compact(F.array(segment, middle)))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
