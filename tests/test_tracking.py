"""Visits from simulated frames of 200 ms, and the same from a stream."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest

from trailmark.functions.geometry import Box, has_moved
from trailmark.operators import tracking
from trailmark.operators.tracking import Camera, Settings, overlaps, really_moved
from trailmark.streaming import pipeline


def told(frames):
    camera, out = Camera(), []
    for at, found in frames:
        out += camera.frame(at, [f[0] for f in found], [f[1] for f in found], np.array([f[2:] for f in found], float).reshape(-1, 4))
    return camera, out


def kinds(out):
    return [(t[1], t[2]) for t in out]


def test_a_person_counts_after_three_sights_and_ends_after_a_gap():
    camera, out = told([(0.2 * i, [("person", 0.8, 0.1, 0.1, 0.2, 0.4)]) for i in range(5)])
    assert kinds(out) == [("started", "person")]
    assert camera.lapse(0.8 + 4.0) == []
    [end] = camera.lapse(0.8 + 4.01)
    assert end[1] == "ended" and end[4] == pytest.approx(0.8)
    assert camera.finish() == []


def test_weak_scores_never_count():
    _, out = told([(0.2 * i, [("person", 0.2, 0.1, 0.1, 0.2, 0.4)]) for i in range(20)])
    assert out == []


def test_a_vehicle_has_to_move_away():
    still = [(0.2 * i, [("vehicle", 0.9, 0.2, 0.2, 0.4, 0.4)]) for i in range(10)]
    assert told(still)[1] == []
    moving = [(2 + 0.2 * i, [("vehicle", 0.9, 0.2 + 0.01 * i, 0.2, 0.4 + 0.01 * i, 0.4)]) for i in range(20)]
    assert kinds(told(still + moving)[1])[0] == ("started", "vehicle")


def test_what_parks_ends_and_starts_nothing_where_it_stands():
    stay = [(0.2 * i, [("animal", 0.9, 0.2, 0.2, 0.4, 0.4)]) for i in range(150)]
    camera, out = told(stay)
    assert [k for k in kinds(out) if k[0] != "updated"] == [("started", "animal"), ("ended", "animal")]
    again = [(60 + 0.2 * i, [("animal", 0.9, 0.2, 0.2, 0.4, 0.4)]) for i in range(10)]
    assert told(stay + again)[1] == out


def test_labels_never_mix_and_the_best_overlap_wins():
    frames = [(0.2 * i, [("person", 0.8, 0.1, 0.1, 0.3, 0.4), ("animal", 0.8, 0.1, 0.1, 0.3, 0.4), ("person", 0.7, 0.15, 0.1, 0.35, 0.4)]) for i in range(4)]
    camera, out = told(frames)
    assert len(camera.visits) == 3
    assert [v.box.tolist() for v in camera.visits] == [[0.1, 0.1, 0.3, 0.4], [0.1, 0.1, 0.3, 0.4], [0.15, 0.1, 0.35, 0.4]]


def test_medians_cover_the_last_hundred_scores():
    frames = [(0.2 * i, [("person", 0.9 if i < 50 else 0.5, 0.1, 0.1 + (i % 2) * 0.1, 0.3, 0.4)]) for i in range(200)]
    camera, _ = told(frames)
    assert max(len(v.scores) for v in camera.visits) == 100
    assert {max(v.scores) for v in camera.visits if v.hits > 150} <= {0.5}


def test_movement_rule_is_one_in_python_and_spark(spark):
    rng = np.random.default_rng(1)
    low = rng.uniform(-0.02, 0.6, (300, 2))
    a = np.hstack([low, low + rng.uniform(0.05, 0.4, (300, 2))])
    b = np.where(rng.random((300, 1)) < 0.5, a + np.tile(rng.uniform(-0.1, 0.1, (300, 2)), 2), a + rng.uniform(-0.2, 0.2, (300, 4)))
    rows = spark.createDataFrame([(i, *x, *y) for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))], "i int, " + ", ".join(f"{p}{c} double" for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2")))
    got = {r["i"]: r["m"] for r in rows.select("i", has_moved(Box.of("a_"), Box.of("b_"), 0.15).alias("m")).collect()}
    assert got == {i: really_moved(x, y, Settings()) for i, (x, y) in enumerate(zip(a, b, strict=True))}
    iou = {r["i"]: r["v"] for r in rows.select("i", Box.of("a_").iou(Box.of("b_")).alias("v")).collect()}
    assert np.allclose([iou[i] for i in range(300)], overlaps(a, b).diagonal())


def test_a_stream_tells_what_a_batch_tells(spark, sf_dir, tmp_path):
    from trailmark.plans.stateful import moving_detections

    rows = moving_detections(spark, sf_dir)
    cut = rows.approxQuantile("at", [0.5], 0.0)[0]
    rows.where(f"at <= {cut}").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where(f"at > {cut}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = pipeline.drained(tracking.visits_stream(stream), "visits").collect()
    batch = tracking.visits(rows).collect()
    ended = [r for r in batch if r not in streamed]
    assert streamed and set(streamed) <= set(batch)
    assert all(r["kind"] == "ended" for r in ended)


def test_a_long_visit_is_told_in_parts_and_other_labels_are_silent():
    settings = Settings(longest_seconds=3.0, labels=("person",), parked_seconds=0)
    frames = [(0.5 * i, [("person", 0.8, 0.1, 0.1, 0.2, 0.4), ("animal", 0.8, 0.6, 0.6, 0.8, 0.9)]) for i in range(17)]
    camera = Camera(settings)
    out = [t for at, f in frames for t in camera.frame(at, [x[0] for x in f], [x[1] for x in f], np.array([x[2:] for x in f], float))]
    out += camera.finish()
    assert {t[2] for t in out} == {"person"}
    assert [(t[1], t[3], t[4]) for t in out if t[1] != "updated"] == [("started", 0.0, 1.0), ("ended", 0.0, 3.0), ("started", 3.0, 3.0), ("ended", 3.0, 6.0), ("started", 6.0, 6.0), ("ended", 6.0, 8.0)]
    assert len({t[0] for t in out}) == 1


def test_event_time_ends_the_visits_of_a_silent_camera(spark, tmp_path):
    def write(camera: str, times: list[float]) -> None:
        rows = [(camera, 1000 + t, "person", 0.9, 0.1, 0.1, 0.2, 0.4) for t in times]
        spark.createDataFrame(rows, "camera_id string, at double, label string, score double, x1 double, y1 double, x2 double, y2 double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write("quiet", [0.2 * i for i in range(10)])
    write("busy", [0.2 * i for i in range(100)])
    write("busy", [20 + 0.2 * i for i in range(10)])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    settings = Settings(parked_seconds=0)
    rows = pipeline.drained(tracking.visits_stream(stream, settings, "1 second"), "silent").collect()
    assert [(r["kind"], round(r["at"], 1)) for r in rows if r["camera_id"] == "quiet" and r["kind"] != "updated"] == [("started", 1000.4), ("ended", 1001.8)]
    assert [r["kind"] for r in rows if r["camera_id"] == "busy" and r["kind"] == "ended"] == []


def test_clips_meet_their_segments_in_a_stream(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00'"
    events = spark.range(40).selectExpr("concat('c', cast(id % 2 as string)) as camera_id", "id", f"{at} + make_interval(0, 0, 0, 0, cast(id as int)) as from_at", f"{at} + make_interval(0, 0, 0, 0, cast(id as int), 1) as to_at")
    segments = spark.range(20).selectExpr("concat('c', cast(id % 2 as string)) as camera_id", "id as segment_id", f"{at} + make_interval(0, 0, 0, 0, cast(id as int), 0, 30) as seg_start", f"{at} + make_interval(0, 0, 0, 0, cast(id as int), 2) as seg_end")
    for name, rows in (("e", events), ("s", segments)):
        rows.where("id < 30" if name == "e" else "segment_id < 15").coalesce(1).write.parquet(str(tmp_path / name))
        rows.where("id >= 30" if name == "e" else "segment_id >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, rows: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = pipeline.drained(pipeline.clips_with_segments(read("e", events), read("s", segments)), "clips").where("segment_id is not null")
    want = events.join(segments.withColumnRenamed("camera_id", "k")).where("camera_id = k and seg_start < to_at and seg_end > from_at")
    assert sorted((r["id"], r["segment_id"]) for r in got.collect()) == sorted((r["id"], r["segment_id"]) for r in want.collect())


def test_frames_make_no_arrays(monkeypatch):
    """Arrays of a box or two took most of the time of visits and looks; what is told is what plain medians and boxes say."""

    def none(*_, **__):
        raise AssertionError("an array of a few numbers")

    for name in ("median", "clip", "minimum", "maximum", "tile", "stack"):
        monkeypatch.setattr(tracking.np, name, none)
    rng, camera, scores, out = random.Random(1), Camera(Settings(due_seconds=0.5, parked_seconds=0)), [], []
    for i in range(400):
        if i % 5 != 3:
            scores.append(0.3 + rng.random() / 2)
            box = (0.1 + 0.001 * i, 0.1, 0.3 + 0.001 * i, 0.4)
            told = camera.frame(0.25 * i, ["person"], scores[-1:], np.array([box]))
        else:
            told = camera.frame(0.25 * i, [], [], np.zeros((0, 4)))
        out += [(t, list(scores[:-1] if i % 5 != 3 else scores)) for t in told if t[1] == "due"]
        for t in told:
            if t[1] in ("started", "updated"):
                assert (t[5], t[6], t[7]) == (max(scores[-100:]), statistics.median(scores[-100:]), len(scores))
    # A frame with nothing in it comes 0.25 s after the last sight, the next one 0.5 s after it.
    assert len(out) == 80
    for t, before in out:
        assert (t[5], t[6]) == (max(before[-100:]), statistics.median(before[-100:]))
        x1 = 0.1 + 0.001 * (round(t[4] / 0.25) - 2)
        assert t[8] == pytest.approx(x1 + 0.002, abs=1e-3)


def test_a_score_that_is_none_makes_the_median_none():
    _, out = told([(0.2 * i, [("person", float("nan") if i == 1 else 0.8, 0.1, 0.1, 0.2, 0.4)]) for i in range(10)])
    assert kinds(out)[0] == ("started", "person") and np.isnan(out[0][6]) and out[0][5] == 0.8


def test_movement_is_judged_without_arrays(monkeypatch):
    """A vehicle's movement was judged by numpy's functions of one number each; the answers are the rule's."""

    def none(*_, **__):
        raise AssertionError("an array function of one number")

    for name in ("hypot", "divide"):
        monkeypatch.setattr(tracking.np, name, none)
    here, s = (0.4, 0.4, 0.6, 0.6), Settings()
    assert really_moved(here, (0.45, 0.4, 0.65, 0.6), s) and not really_moved(here, (0.43, 0.4, 0.63, 0.6), s)
    assert really_moved(here, (0.3, 0.3, 0.7, 0.7), s) and not really_moved(here, (0.38, 0.38, 0.62, 0.62), s)
    assert not really_moved((0.0, 0.4, 0.2, 0.6), (0.1, 0.4, 0.3, 0.6), s)
    for odd in (float("nan"), float("inf")):
        assert not really_moved((0.4, 0.4, 0.6, odd), (0.3, 0.3, 0.7, odd), s)
    moving = [(0.2 * i, [("vehicle", 0.9, 0.2 + 0.01 * i, 0.2, 0.4 + 0.01 * i, 0.4)]) for i in range(20)]
    assert kinds(told(moving)[1])[0] == ("started", "vehicle")


def test_frames_of_events_come_from_one_pass(spark, tmp_path):
    """The best event of a frame for what drifts, the best one that is no error for what stays; events were read twice."""
    from trailmark.plans.stateful import moving_detections

    rng = random.Random(2)
    events = [(i, rng.choice([None, *range(30)]), rng.choice(["error", "view", None]), rng.choice([None, 1.0, 20.0, 300.0])) for i in [None, *range(7000)]]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    want: dict[tuple, list[float]] = {}
    for i, user, kind, value in events:
        for label in ["vehicle", "animal"] if kind not in ("error", None) else ["vehicle"]:
            want.setdefault((None if user is None else f"camera{user}", None if i is None else i // 50, label), []).extend([] if value is None else [value])
    best = lambda key, values: max(({"vehicle": 0.4, "animal": 0.35}[key[2]] + v / 1000 for v in values), default=None)
    place = lambda n, label: (0.6, 0.6, 0.8, 0.9) if label == "animal" else (None, 0.2, None, 0.5) if n is None else (n % 60 / 100 + 0.02, 0.2, n % 60 / 100 + 0.32, 0.5)
    rows = moving_detections(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(repr((k[0], None if k[1] is None else k[1] * 0.2, k[2], best(k, v), *place(k[1], k[2]))) for k, v in want.items())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_cameras_are_not_merged_into_few_tasks(spark, sf_dir):
    """By bytes, Spark merged the cameras of a large table into a few more tasks than cores."""
    from trailmark.plans.stateful import moving_detections

    assert "REPARTITION_BY_NUM" in tracking.visits(moving_detections(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
