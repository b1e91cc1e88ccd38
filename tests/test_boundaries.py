"""Sources, sinks and the model boundary, read back or held against brute force."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from wirespan.functions.params import Params
from wirespan.operators import drawing, fuse, graph, models
from wirespan.sources import images
from wirespan.sources.tables import counted_table


def test_read_pictures(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.jpeg", "d.txt", "e.f.png"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "g.png").write_bytes(b"x")
    got = {(r.name, bytes(r.content)) for r in images.read_pictures(spark, str(tmp_path)).collect()}
    assert got == {("a", b"a.png"), ("b", b"b.JPG"), ("c", b"c.jpeg"), ("e.f", b"e.f.png")}


ROWS = [(1, "A,1", None), (1, 'say "x"', "B"), (2, "C", "D")]


def test_write_csv(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "page_id bigint, from_device string, signal string")
    drawing.write_csv(rows, {"from_device": "From", "signal": "Signal"}, str(tmp_path / "out"))
    read = lambda page: [f.read_bytes().decode("utf-8-sig").splitlines() for f in (tmp_path / "out" / f"page_id={page}").glob("*.txt")]
    assert len(read(1)) == 1 and read(1)[0][0] == "From,Signal" and set(read(1)[0][1:]) == {'"A,1",', '"say ""x""",B'}
    assert read(2) == [["From,Signal", "C,D"]]
    assert next((tmp_path / "out" / "page_id=2").glob("*.txt")).read_bytes().startswith(b"\xef\xbb\xbf")


def test_write_json(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "page_id bigint, from_device string, signal string")
    drawing.write_json(rows, ["from_device", "signal"], str(tmp_path / "out"))
    found = [json.loads(line) for f in (tmp_path / "out").glob("*/*.json") for line in f.read_text().splitlines()]
    assert sorted(found, key=str) == sorted([{"from_device": a, "signal": b} for _, a, b in ROWS], key=str)


def test_texts_of_failing_batches(spark):
    def load():
        def model(rows: pd.DataFrame) -> list[str]:
            if (rows.det_idx % 5 == 3).any():
                raise ValueError("unreadable")
            return [f"t{i}" for i in rows.det_idx]

        return model

    regions = spark.createDataFrame([(i // 20, i) for i in range(40)], "page_id bigint, det_idx int").repartition(2)
    got = {r.det_idx: r.text for r in models.infer_texts(regions, load).collect()}
    assert got == {i: "" if i % 5 == 3 else f"t{i}" for i in range(40)}


def test_texts_go_with_regions_by_place(spark):
    regions = spark.createDataFrame([(1, 3), (1, 5), (1, 9), (2, 0)], "page_id bigint, det_idx int")
    texts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 4, "c"), (2, 5, "d")], "page_id bigint, det_idx int, text string")
    assert {(r.page_id, r.det_idx, r.text) for r in models.zip_texts(regions, texts).collect()} == {(1, 3, "a"), (1, 5, "b"), (2, 0, "c")}


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0


def test_detections_are_suppressed_as_one_by_one(spark):
    rng = random.Random(4)
    boxes = {(p, i): (x := rng.randrange(60), y := rng.randrange(60), x + 20, y + 20 + i % 3) for p in range(5) for i in range(30)}
    score = {k: rng.randrange(10) / 10 for k in boxes}

    def load():
        def model(rows: pd.DataFrame) -> pd.DataFrame:
            out = [(p, i, i % 2, score[p, i], *map(float, boxes[p, i])) for p in rows.page_id for i in range(30)]
            return pd.DataFrame(out, columns=[c.split(" ")[0] for c in models.DETECTIONS.split(", ")])

        return model

    found = models.infer_objects(spark.createDataFrame([(p,) for p in range(5)], "page_id bigint"), load)
    got = {(r.page_id, r.det_idx) for r in fuse.suppress_overlaps(found, 0.1).collect()}
    wanted = set()
    for p in range(5):
        kept: list = []
        for i in sorted(range(30), key=lambda i: (-score[p, i], i)):
            if all(i % 2 != j % 2 or iou(boxes[p, i], boxes[p, j]) <= 0.1 for j in kept):
                kept.append(i)
        wanted |= {(p, i) for i in kept}
    assert got == wanted and 5 < len(got) < 150


def test_clusters_with_other_parameters(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 12.0, 0.0), (1, 1, 24.0, 0.0, 200.0, 0.0)], "page_id bigint, line_idx int, x1 double, y1 double, x2 double, y2 double")
    places = lambda p: sorted((r.x, r.y) for r in graph.junctions(graph.clustered(lines, p)).collect())
    assert places(Params()) == [(12.0, 0.0), (200.0, 0.0)]
    assert places(Params(merge_distance=12.0)) == [(0.0, 0.0), (12.0, 0.0), (24.0, 0.0), (200.0, 0.0)]
    assert graph.clustered(lines.where(F.lit(False))).collect() == []


def files(folder) -> dict:
    return {str(f.parent.name): f.read_bytes() for f in folder.glob("*/part-*") if not f.name.startswith(".")}


def test_sinks_replace_the_pages_they_write(spark, tmp_path):
    rows = lambda r: spark.createDataFrame(r, "page_id bigint, from_device string, signal string")
    for write, columns in ((drawing.write_csv, {"from_device": "From", "signal": "Signal"}), (drawing.write_json, ["from_device", "signal"])):
        path = tmp_path / write.__name__
        write(rows(ROWS[:1] + ROWS[2:]), columns, str(path))
        first = files(path)
        write(rows(ROWS[:1] + ROWS[2:]), columns, str(path))
        assert files(path) == first and len(first) == 2
        write(rows([(2, "other", None)]), columns, str(path))
        assert files(path)["page_id=1"] == first["page_id=1"] and b"other" in files(path)["page_id=2"]


def test_a_sink_whose_job_fails_changes_nothing(spark, tmp_path):
    path = tmp_path / "out"
    drawing.write_csv(spark.createDataFrame(ROWS, "page_id bigint, from_device string, signal string"), {"signal": "Signal"}, str(path))
    first = files(path)
    failing = spark.range(100).selectExpr("id % 3 as page_id", "case when id = 77 then raise_error('lost') else 'x' end as signal")
    try:
        drawing.write_csv(failing, {"signal": "Signal"}, str(path))
        raise AssertionError("it must fail")
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    assert files(path) == first


def test_table_function_asks_by_page(spark):
    def load():
        def model(rows):
            if any(r.det_idx % 7 == 3 for r in rows):
                raise ValueError("unreadable")
            return [f"{len(rows)}:{r.det_idx}" for r in rows]

        return model

    regions = spark.createDataFrame([(p, i) for p in range(3) for i in range(p, 14 * p, 2)], "page_id bigint, det_idx int").repartition(4)
    got = {(r.page_id, r.place): r.text for r in models.texts_by_page(regions, load).collect()}
    ids = {p: list(range(p, 14 * p, 2)) for p in range(3)}
    assert got == {(1, k + 1): "" if i % 7 == 3 else f"1:{i}" for k, i in enumerate(ids[1])} | {(2, k + 1): "" if i % 7 == 3 else f"1:{i}" for k, i in enumerate(ids[2])}
    even = spark.createDataFrame([(5, i) for i in range(0, 28, 4) if i % 7 != 3], "page_id bigint, det_idx int")
    texts = [r.text for r in models.texts_by_page(even, load).orderBy("place").collect()]
    assert texts == [f"{6 if k < 6 else len(texts) - 6}:{r.det_idx}" for k, r in enumerate(even.orderBy("det_idx").collect())]


def test_records_of_other_pages_answer_nothing(spark):
    pictures = spark.createDataFrame([(1,), (2,)], "page_id bigint")
    recorded = spark.createDataFrame([(1, 0, 1, 0.9, 0.0, 0.0, 1.0, 1.0), (1, 1, 1, 0.01, 0.0, 0.0, 1.0, 1.0), (1, 2, 1, None, 0.0, 0.0, 1.0, 1.0), (3, 0, 1, 0.9, 0.0, 0.0, 1.0, 1.0)], models.DETECTIONS)
    assert [(r.page_id, r.det_idx) for r in models.recorded_objects(pictures, recorded).collect()] == [(1, 0)]


def test_layered_settings(spark, tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"model": {"size": 512, "head": {"lines": 5000}}, "device": "cpu"}))
    (tmp_path / "own.json").write_text(json.dumps({"model": {"head": {"lines": 1000}}, "score": 0.05}))
    settings = models.layered_settings(spark, str(tmp_path / "base.json"), str(tmp_path / "own.json"))

    def load():
        own = settings()
        return lambda rows: [(rows[0].page_id, json.dumps(own, sort_keys=True))]

    rows = spark.range(20).selectExpr("id as page_id")
    got = {r.text for r in models.by_partition(rows, ["page_id"], ["page_id"], load, "page_id bigint, text string").collect()}
    assert [json.loads(t) for t in got] == [{"model": {"size": 512, "head": {"lines": 1000}}, "device": "cpu", "score": 0.05}]


def test_counts_are_those_of_the_tables(spark):
    table, counts = counted_table(spark.range(1000), rows=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert counts == {"rows": 1000, "odd": 500} and table.count() == 1000
    assert counted_table(spark.range(0), total=F.sum("id"))[1] == {"total": 0}
