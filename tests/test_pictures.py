"""Running backgrounds and connected areas against plain walks; the stream against the table."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import pictures
from trailmark.operators.pictures import Settings

SCHEMA = "camera_id string, frame long, width int, height int, luma array<int>, warm array<boolean>"


def plain(planes, settings, masks):
    """Cell by cell: (camera, frame) -> share and set of shown cells."""
    ground, seen, out = {}, {}, {}
    for camera, frame, w, h, luma, warm in sorted(planes, key=lambda p: (p[0], p[1])):
        at = lambda x, y: luma[min(max(y, 0), h - 1) * w + min(max(x, 0), w - 1)]
        soft = [(sum(at(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) + 4) // 9 * 16 for y in range(h) for x in range(w)]
        if len(ground.get(camera, [])) != w * h:
            ground[camera], seen[camera] = soft, 1
            out[camera, frame] = (0.0, set())
            continue
        g = ground[camera]
        seen[camera] += 1
        hidden = pictures.masked(masks.get(camera, []), w, h).ravel()
        changed = [abs(soft[i] - g[i]) > settings.threshold * 16 and not hidden[i] for i in range(w * h)]
        share = sum(changed) / (w * h)
        if share > settings.flash:
            ground[camera], seen[camera] = soft, settings.warm_up
            out[camera, frame] = (share, set())
            continue
        on = [c and (warm is None or warm[i]) for i, c in enumerate(changed)]
        grown = {i for i in range(w * h) if any(on[y * w + x] for x in range(max(i % w - 1, 0), min(i % w + 2, w)) for y in range(max(i // w - 1, 0), min(i // w + 2, h)))}
        alpha = max(1, round(settings.alpha * 256))
        ground[camera] = [b + ((s - b) * (max(1, alpha // 4) if i in grown else alpha) >> 8) for i, (b, s) in enumerate(zip(g, soft, strict=True))]
        out[camera, frame] = (share, grown if seen[camera] > settings.warm_up else set())
    return out


def flood(cells, w, least):
    left, found = set(cells), []
    while left:
        area, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                area.add(i)
                todo += [j for j in left if abs(j % w - i % w) <= 1 and abs(j // w - i // w) <= 1]
        if len(area) >= least:
            xs, ys = [i % w for i in area], [i // w for i in area]
            found.append((-len(area), min(area), min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(found)


@pytest.fixture(scope="module")
def planes():
    rng = random.Random(4)
    out = []
    for camera, w, h in (("a", 12, 7), ("b", 5, 9), ("c", 1, 1)):
        base = [rng.randint(20, 120) for _ in range(w * h)]
        for frame in range(60):
            if camera == "b" and frame == 40:
                w, h = 9, 5  # another resolution with as many cells
            luma = [min(255, v + rng.randint(0, 6) + (150 if frame in (25, 26) else 0)) for v in base]
            for x, y, size in ((frame % 9, 1, 2), (9 - frame % 10, 4, 3)):
                for i in range(w * h):
                    if frame > 4 and x <= i % w < x + size and y <= i // w < y + size:
                        luma[i] = 255
            out.append((camera, frame, w, h, luma, [i % 3 > 0 for i in range(w * h)] if camera == "b" else None))
    return out


MASKS = {"a": [[(0.0, 0.0), (0.4, 0.0), (0.4, 1.0), (0.0, 1.0)], [(0.9, 0.9), (1.0, 1.0)]]}
SETTINGS = Settings(area=0.03, warm_up=6)


def same_shape_resets(planes):
    """A plain walk knows sizes by their product; the other resolution of b starts anew, so it's a camera of its own there."""
    return [("b2" if c == "b" and f >= 40 else c, f, *rest) for c, f, *rest in planes]


def test_backgrounds_like_a_plain_walk(spark, planes):
    got = pictures.changes(spark.createDataFrame(planes, SCHEMA), SETTINGS, MASKS)
    want = plain(same_shape_resets(planes), SETTINGS, MASKS)
    want = {("b" if c == "b2" else c, f): v for (c, f), v in want.items()}
    rows = {(r["camera_id"], r["frame"]): (r["changed_share"], {y * r["width"] + x for y, x1, x2 in r["runs"] for x in range(x1, x2 + 1)}) for r in got.collect()}
    assert rows.keys() == want.keys()
    for k, (share, cells) in want.items():
        assert rows[k][0] == pytest.approx(share) and rows[k][1] == cells, k
    assert sum(bool(cells) for _, cells in want.values()) > 60
    sizes = {(c, f): (w, h) for c, f, w, h, *_ in planes}
    boxes = {}
    for r in pictures.motion_boxes(got, SETTINGS.area).orderBy("camera_id", "frame", "place").collect():
        w, h = sizes[r["camera_id"], r["frame"]]
        boxes.setdefault((r["camera_id"], r["frame"]), []).append((-r["n"], *(round(v * s) for v, s in ((r["x1"], w), (r["y1"], h), (r["x2"], w), (r["y2"], h)))))
    for k, (_, cells) in want.items():
        w, h = sizes[k]
        assert boxes.get(k, []) == [(f[0], *f[2:]) for f in flood(cells, w, int(max(w * h * SETTINGS.area, 1)))], k


def test_areas_of_odd_shapes(spark):
    rng = np.random.default_rng(3)
    shapes = [rng.random((rng.integers(1, 12), rng.integers(1, 12))) < p for p in (0.2, 0.35, 0.5, 0.7) for _ in range(60)]
    spiral = np.array([[c == "#" for c in row] for row in ("#######", "#.....#", "#.###.#", "#.#.#.#", "#.#...#", "#.#####", "#......")])
    shapes += [spiral, np.zeros((3, 3), bool), np.ones((3, 3), bool), np.eye(5, dtype=bool)]
    rows = [("c", i, s.shape[1], s.shape[0], 0.0, pictures.runs_of(s)) for i, s in enumerate(shapes)]
    got = {}
    for r in pictures.motion_boxes(spark.createDataFrame(rows, pictures.RUNS), 0.0).orderBy("frame", "place").collect():
        got.setdefault(r["frame"], []).append(-r["n"])
    assert got == {i: [f[0] for f in found] for i, s in enumerate(shapes) if (found := flood(set(np.flatnonzero(s.ravel()).tolist()), s.shape[1], 1))}


def test_planes_that_are_none_are_left_out(spark):
    rows = [("a", 1, 2, 2, [1, 2, 3], None), ("a", 2, 2, 2, None, None), ("a", 3, 0, 0, [], None), ("a", 4, 1, 1, [None], None), ("a", 5, 2, 1, [1, 2], None), (None, 6, 1, 1, [5], None)]
    got = pictures.changes(spark.createDataFrame(rows, SCHEMA).withColumn("clash", F.lit(1)))
    assert sorted(r["frame"] for r in got.collect()) == [5, 6]
    assert pictures.motion_boxes(got).isEmpty()


def test_downscaling_and_masks():
    plane = np.arange(24).reshape(4, 6)
    assert pictures.downscaled(plane, 9) is plane
    assert pictures.downscaled(plane, 3).tolist() == [[4, 6, 8], [16, 18, 20]]
    third = pictures.downscaled(np.full((7, 10), 77), 3)
    assert third.shape == (2, 3) and (third == 77).all()
    assert pictures.masked([[(0, 0), (1, 0), (1, 1), (0, 1)]], 3, 2).all()
    assert not pictures.masked([[(0, 0), (1, 1)]], 3, 2).any()
    assert pictures.masked([[(0, 0), (0.5, 0), (0.5, 1), (0, 1)]], 4, 2).tolist() == [[True, True, False, False]] * 2


def test_stream_of_planes_is_the_table_over_batches_and_a_restart(spark, planes, tmp_path):
    table = spark.createDataFrame(planes, SCHEMA)
    want = {tuple(map(str, r)) for r in pictures.changes(table, SETTINGS, MASKS).collect()}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):
            table.where(F.floor(F.col("frame") / 20) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            # Each turn is a query of its own that goes on from the checkpoint of the one before.
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            pictures.changes_stream(stream, SETTINGS, MASKS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(map(str, r)) for r in spark.read.schema(pictures.RUNS).parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(want) and set(got) == want
