"""Tensor layouts, class sets and answers without secrets, case by case."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trailmark.functions import text
from trailmark.operators import tensors

SCHEMA = "frame long, layout string, shape array<int>, values array<double>"


def found(spark, layout, shape, values, threshold=0.2):
    d = tensors.candidates(spark.createDataFrame([(1, layout, shape, values)], SCHEMA), 320.0, threshold)
    return [(r["i"], r["class"], round(r["score"], 6), *(round(r[c], 6) for c in ("x1", "y1", "x2", "y2"))) for r in d.orderBy("i").collect()]


def test_layouts(spark):
    rows = [160, 160, 64, 32, 0.9, 0.1, 0.8, 0.1, 10, 10, 4, 4, 0.1, 0.9, 0.0, 0.0]
    assert found(spark, "rows", [1, 2, 8], list(map(float, rows))) == [(0, 1, 0.72, 0.4, 0.45, 0.6, 0.55)]
    # A tensor that ends early has only its whole rows; what's beyond the shape isn't read.
    assert found(spark, "rows", [1, 5, 8], list(map(float, rows[:12]))) == [(0, 1, 0.72, 0.4, 0.45, 0.6, 0.55)]
    assert len(found(spark, "rows", [1, 1, 8], list(map(float, rows)), 0.0)) == 1
    columns = [160, 0, 160, 0, 64, 320, 32, 320, 0.1, 0.5, 0.8, 0.5]
    assert found(spark, "columns", [1, 6, 2], list(map(float, columns))) == [(0, 1, 0.8, 0.4, 0.45, 0.6, 0.55), (1, 0, 0.5, 0.0, 0.0, 0.5, 0.5)]
    boxes = [128, 144, 192, 176, 0.8, 1, 300, 300, 10, 400, 0.9, -1, 0, 0, 1, 1, 0.1, 0]
    assert found(spark, "boxes", [1, 3, 6], list(map(float, boxes))) == [(0, 1, 0.8, 0.4, 0.45, 0.6, 0.55), (1, 0, 0.9, 0.03125, 0.9375, 0.9375, 1.0)]
    assert found(spark, "boxes", [1, 0, 6], []) == []
    assert found(spark, "columns", [1, 5, 1], [1.0, 1.0, 1.0, 1.0, float("nan")]) == []


@pytest.mark.parametrize(("layout", "shape"), [("rows", [1, 2, 5]), ("columns", [1, 4, 2]), ("boxes", [1, 1, 7]), ("rows", [2, 1, 8]), ("rows", [1, 8]), ("other", [1, 2, 8])])
def test_other_shapes_stop_the_query(spark, layout, shape):
    with pytest.raises(Exception, match="unexpected shape"):
        found(spark, layout, shape, [0.0] * 16)


def test_the_best_of_a_class_stays_and_other_classes_too(spark):
    box = lambda x, y, w, h: [x * 320, y * 320, (x + w) * 320, (y + h) * 320]
    values = [*box(0.1, 0.1, 0.3, 0.3), 0.9, 0, *box(0.12, 0.1, 0.3, 0.3), 0.8, 0, *box(0.12, 0.1, 0.3, 0.3), 0.7, 1, *box(0.6, 0.6, 0.3, 0.3), 0.6, 0, *box(0.6, 0.1, 0.0, 0.0), 0.5, 0, *box(0.6, 0.1, 0.0, 0.0), 0.4, 0, *box(0.1, 0.6, 0.1, 0.1), 0.9, 9]
    table = spark.createDataFrame([(1, "boxes", [1, 7, 6], list(map(float, values)))], SCHEMA)
    got = lambda classes: [(r["label"], r["raw_class"], r["score"]) for r in tensors.detected(table, 320.0, 0.2, classes).orderBy(F.desc("score")).collect()]
    assert got(tensors.ANIMALS) == [("animal", "animal", 0.9), ("person", "person", 0.7), ("animal", "animal", 0.6), ("animal", "animal", 0.5), ("animal", "animal", 0.4)]
    assert [g[:2] for g in got(tensors.COCO)][:2] == [("person", "person"), ("vehicle", "bicycle")]
    assert {tensors.COCO[i][1] for i in (2, 8, 14, 16, 23)} == {"car", "boat", "bird", "dog", "giraffe"} and 4 not in tensors.COCO and len(tensors.COCO) == 18


def test_secrets_go_at_every_depth(spark):
    deep = {"Token": {"name": "s3cret", "leaseTime": 1}, "a": [{"b": {"PASSWORD": ["s3cret"], "Token": "not an object"}}, 1.5, None, "é"], "token": {"name": "stays"}}
    given = [json.dumps(deep, indent=2), "not json", None, "3", json.dumps([[[{"password": None}]]]), "{}"]
    rows = spark.createDataFrame([(x,) for x in given], "v string").select(text.redacted_json(F.col("v")).alias("r")).collect()
    deep["Token"]["name"] = deep["a"][0]["b"]["PASSWORD"] = "REDACTED"
    assert [r["r"] for r in rows] == [json.dumps(deep, ensure_ascii=False, separators=(",", ":")), None, None, "3", '[[[{"password":"REDACTED"}]]]', "{}"]
