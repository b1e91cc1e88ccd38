"""The boundary to recognition models: a callable for each batch of rows, or a table function that gets a picture's rows at once.

Without model weights, recorded answers stand for a model: rows of a table go to the table function beside what is asked,
and it answers a question with what is recorded for it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], pd.DataFrame]

DETECTIONS = "page_id bigint, det_idx int, class_id int, confidence double, x_min double, y_min double, x_max double, y_max double"
LINES = "page_id bigint, row int, col int, line_idx int, x1 double, y1 double, x2 double, y2 double, score double"
TEXTS = "page_id bigint, det_idx int, text string"


def infer(rows: DataFrame, load: Callable[[], Model], schema: str) -> DataFrame:
    """A model over all rows: loaded once for each worker's stream, called for each Arrow batch, any number of rows out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def infer_objects(pictures: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Detections of pictures; a model that fails fails the job, as there is no rule for it."""
    return infer(pictures, load, DETECTIONS)


def infer_lines(tiles: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Lines of tiles; a tile on which the model fails has none."""

    def tolerant() -> Model:
        model = load()

        def each(batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for i in range(len(batch)):
                try:
                    out.append(model(batch.iloc[i : i + 1]))
                except Exception:  # noqa: BLE001  the rule for this model: a failed tile is an empty one
                    continue
            return pd.concat(out) if out else pd.DataFrame(columns=[c.split(" ")[0] for c in LINES.split(", ")])

        return each

    return infer(tiles, tolerant, LINES)


def infer_texts(regions: DataFrame, load: Callable[[], Model], batch: int = 6) -> DataFrame:
    """Texts of regions, up to ``batch`` at a time; if a batch fails its regions go one by one, and one that fails is empty."""

    def tolerant() -> Model:
        model = load()

        def each(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for a in range(0, len(rows), batch):
                part = rows.iloc[a : a + batch]
                try:
                    texts = list(model(part))
                except Exception:  # noqa: BLE001
                    texts = []
                    for i in range(len(part)):
                        try:
                            texts += list(model(part.iloc[i : i + 1]))
                        except Exception:  # noqa: BLE001
                            texts.append("")
                out.append(part[["page_id", "det_idx"]].assign(text=texts))
            return pd.concat(out) if out else rows[["page_id", "det_idx"]].assign(text=[])

        return each

    return infer(regions, tolerant, TEXTS)


def zip_texts(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Regions with the text of the same place in the page's order; what one side has more is left out."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("det_idx"))
    return regions.withColumn("place", place).join(texts.select("page_id", place.alias("place"), "text"), ["page_id", "place"]).drop("place")


def by_partition(rows: DataFrame, keys: list[str], order: list[str], load: Callable[[], Callable[[list[Row]], Iterable[tuple]]], schema: str) -> DataFrame:
    """A table function over rows: for each partition by ``keys`` what the model gives for its rows, in order.

    The model is loaded once in a task. A partition's rows are held together, as many as a picture has.
    """

    loaded: list = []  # a task's own copy

    @F.udtf(returnType=schema)
    class Ask:
        def __init__(self):
            self.rows = []

        def eval(self, row: Row):
            self.rows.append(row)

        def terminate(self):
            if not loaded:
                loaded.append(load())
            yield from loaded[0](self.rows) if self.rows else ()

    return Ask(rows.asTable().partitionBy(*keys).orderBy(*order))


def recorded_objects(pictures: DataFrame, recorded: DataFrame, least: float = 0.05) -> DataFrame:
    """DETECTIONS of pictures (page_id), as recorded for them: those of a fair confidence. Other pages' records answer nothing."""
    columns = [c.split(" ")[0] for c in DETECTIONS.split(", ")]

    def load():
        def model(rows: list[Row]):
            if not rows[0].asked:
                return
            for r in rows[1:]:
                if r.confidence is not None and r.confidence >= least:
                    yield tuple(r[c] for c in columns)

        return model

    asked = pictures.select("page_id", *[F.lit(None).alias(c) for c in columns[1:]], F.lit(True).alias("asked"))
    both = asked.unionByName(recorded.select(*columns, F.lit(False).alias("asked")))
    return by_partition(both, ["page_id"], ["det_idx"], load, DETECTIONS)  # the picture first, as null is least


def recorded_lines(tiles: DataFrame, recorded: DataFrame) -> DataFrame:
    """LINES of tiles (page_id, row, col), as recorded for them in model coordinates; a null score stands for a model that fails, whose tile has none."""
    columns = [c.split(" ")[0] for c in LINES.split(", ")]

    def load():
        def model(rows: list[Row]):
            if any(r.score is None for r in rows[1:]):
                raise ValueError("recorded failure")
            return [tuple(r[c] for c in columns) for r in rows[1:]]

        def tolerant(rows: list[Row]):
            if not rows[0].asked:
                return []
            try:
                return model(rows)
            except ValueError:
                return []

        return tolerant

    asked = tiles.select("page_id", "row", "col", *[F.lit(None).alias(c) for c in columns[3:]], F.lit(True).alias("asked"))
    both = asked.unionByName(recorded.select(*columns, F.lit(False).alias("asked")))
    return by_partition(both, ["page_id", "row", "col"], ["line_idx"], load, LINES)


def texts_by_page(regions: DataFrame, load: Callable[[], Callable[[list[Row]], list[str]]], batch: int = 6) -> DataFrame:
    """page_id, place (from 1), text of regions (page_id, det_idx, ...) in order, asked for ``batch`` at a time.

    If a batch of a page fails, all of the page's regions go one by one, and one that fails has an empty text.
    """

    def loaded():
        model = load()

        def page(rows: list[Row]):
            try:
                texts = [t for a in range(0, len(rows), batch) for t in model(rows[a : a + batch])]
            except Exception:  # noqa: BLE001  the rule for this model
                texts = []
                for row in rows:
                    try:
                        found = model([row])
                        texts.append(found[0] if found else "")
                    except Exception:  # noqa: BLE001
                        texts.append("")
            return [(rows[0].page_id, i + 1, t) for i, t in enumerate(texts)]

        return page

    return by_partition(regions, ["page_id"], ["det_idx"], loaded, "page_id bigint, place int, text string")


def recorded_texts(regions: DataFrame) -> DataFrame:
    """texts_by_page of regions whose text is recorded as ocr_text; null stands for a model that fails."""

    def load():
        def model(rows: list[Row]) -> list[str]:
            if any(r.ocr_text is None for r in rows):
                raise ValueError("recorded failure")
            return [r.ocr_text for r in rows]

        return model

    return texts_by_page(regions, load)


def at_places(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Regions with the text (page_id, place, text) of their place in the page's order; what one side has more is left out."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("det_idx"))
    return regions.withColumn("place", place).join(texts, ["page_id", "place"]).drop("place")


def merged(base: dict, over: dict) -> dict:
    """base with what ``over`` sets; where both have a group, the groups are merged."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def layered_settings(spark: SparkSession, *files: str) -> Callable[[], dict]:
    """What gives a model's settings within a task: JSON files, later ones over earlier ones, sent to each executor once.

    To be called in a model's ``load``, which runs once in a task. YAML files are read where a reader is installed.
    """
    names = [Path(f).name for f in files]
    if len(set(names)) < len(names):
        raise ValueError(f"settings files of one name: {names}")
    for file in files:
        spark.sparkContext.addFile(file)

    def read(name: str) -> dict:
        text = Path(SparkFiles.get(name)).read_text()
        if not name.endswith((".yaml", ".yml")):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text)

    def settings() -> dict:
        out: dict = {}
        for name in names:
            out = merged(out, read(name))
        return out

    return settings
