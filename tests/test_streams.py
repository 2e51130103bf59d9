"""Streams with state against tables: several micro-batches, and a restart from the checkpoint after each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import analysis, motion, tracking
from trailmark.plans.analysis import looked_at_frames
from trailmark.plans.stateful import moving_detections
from trailmark.streaming import stateful


def fed(spark, tmp_path, tables, at, start, schema, parts=4):
    """What a stream writes that gets tables in parts by time, one restart a part. start: the stream of the given sources."""
    cuts = [min(t.agg(F.min(a)).first()[0] for t, a in zip(tables, at, strict=True)), max(t.agg(F.max(a)).first()[0] for t, a in zip(tables, at, strict=True))]
    width = (cuts[1] - cuts[0]) // parts + 1
    for part in range(parts):
        for k, (table, a) in enumerate(zip(tables, at, strict=True)):
            table.where(F.floor((F.col(a) - cuts[0]) / width) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        sources = [spark.readStream.schema(t.schema).parquet(str(tmp_path / f"in{k}")) for k, t in enumerate(tables)]
        start(*sources).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / "out"))


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_motion_events_of_a_stream(spark, tmp_path):
    rng = random.Random(1)
    frames, at = [], {c: 0 for c in "ab"}
    for i in range(900):
        c = rng.choice("ab")
        at[c] += rng.choice([300, 500, 900]) if rng.random() < 0.97 else 7_000
        frames.append((c, i, at[c], rng.random() < (0.95 if at[c] // 20_000 % 2 else 0.1), rng.random(), rng.random() < 0.01))
    table = spark.createDataFrame(frames, "camera_id string, id long, at_ms long, moving boolean, area double, objects boolean")
    limits = {"cooldown": 8_000, "longest": 9_000}
    want = rows(motion.motion_events(table, **limits))
    got = rows(fed(spark, tmp_path, [table], ["at_ms"], lambda s: stateful.motion_events_stream(s, **limits), motion.EVENT))
    # The stream tells all but what is still open: the last event of a camera.
    last = {max((r for r in want if r[0] == c), key=lambda r: int(r[1])) for c in "ab"}
    assert len(want) > 10 and set(want) - last <= set(got) <= set(want) and len(set(got)) == len(got)


def test_looks_of_a_stream(spark, sf_dir, tmp_path):
    table = looked_at_frames(spark, sf_dir)
    want = analysis.looks(table)
    assert want.where("not looks").count() > 100
    assert rows(fed(spark, tmp_path, [table], ["at_ms"], stateful.looks_stream, analysis.LOOK)) == rows(want)


def test_looks_by_the_rules(spark):
    frame = lambda i, at, moving=True, due=False, found=False: ("c", i, at, moving, due, found)
    given = [frame(i, 100 * i) for i in range(16)] + [frame(16, 2_399), frame(17, 2_400), frame(18, 2_500), frame(19, 2_600, due=True), frame(20, 2_700)]
    given += [frame(30 + i, 3_000 + 100 * i) for i in range(20)] + [frame(60, 15_500, False), frame(61, 15_600)]
    table = spark.createDataFrame([*given, ("c", 99, None, True, True, True)], "camera_id string, id long, at_ms long, moving boolean, due boolean, found boolean")
    got = {r["id"]: (r["looks"], r["fruitless"]) for r in analysis.looks(table).collect()}
    assert [got[i][0] for i in range(16)] == [True] * 15 + [False]
    assert (got[16][0], got[17][0], got[18][0]) == (False, True, False)
    assert got[19] == (True, 0) and got[20] == (True, 1)
    assert got[60] == (False, 0) and got[61] == (True, 1)


@pytest.fixture(scope="module")
def jobs_and_segments(spark):
    rng = random.Random(6)
    jobs, segments, now = [], [], 1_000_000
    for i in range(240):
        now += rng.choice([500, 3_000, 20_000])
        jobs.append((i, rng.choice("ab"), now - 5_000 - rng.choice([0, 9_000]), now + rng.choice([-5_000, 0, 8_000, 30_000]), now))
        start = now - rng.choice([20_000, 4_000, 0])
        end = start + rng.choice([9_000, 40_000])
        segments.append((rng.choice("ab"), start, end, end + rng.choice([100, 2_000, 80_000])))
    jobs.append((999, "z", 5, 5, now))
    return spark.createDataFrame(jobs, "id long, camera_id string, from_ms long, to_ms long, asked_ms long"), spark.createDataFrame(segments, "camera_id string, start_ms long, end_ms long, known_ms long")


def test_clips_of_a_table(jobs_and_segments):
    jobs, segments = jobs_and_segments
    want = []
    for i, c, lo, hi, asked in jobs.collect():
        meets = [s[1:] for s in segments.collect() if s[0] == c and lo < hi and s[2] > lo and s[1] < hi and s[1] >= lo - 600_000]
        reached = [max(k, asked) for _, end, k in meets if end >= hi and k <= asked + 60_000]
        decided = min([asked + 60_000, *reached])
        taken = [s for s, _, k in meets if k <= decided]
        want.append((c, i, decided, bool(reached), len(taken), max([lo, *([min(taken)] if taken else [])])))
    assert rows(analysis.clip_jobs(jobs, segments)) == sorted(tuple(map(str, r)) for r in want)
    assert {r[3] for r in want} == {True, False} and {r[4] for r in want} > {0, 1, 2}


def test_clips_of_streams_with_deadlines(spark, jobs_and_segments, tmp_path):
    jobs, segments = jobs_and_segments
    # A last row of each stream, long after, moves the watermark past every deadline; then one more lets timers go off.
    last = lambda n: (spark.createDataFrame([(10_000 + n, "end", 0, 1, 10**8 * (n + 1))], jobs.schema), spark.createDataFrame([("end", 0, 1, 10**8 * (n + 1))], segments.schema))
    for n in range(2):
        more = last(n)
        jobs, segments = jobs.unionByName(more[0]), segments.unionByName(more[1])
    source = tmp_path / "s"
    want = rows(analysis.clip_jobs(*jobs_and_segments))
    small = lambda c: F.when(F.col(c) < 10**8, F.col(c)).otherwise(F.col(c) - 10**8 + 3_000_000)
    ready = [jobs.withColumn("part", small("asked_ms")), segments.withColumn("part", small("known_ms"))]
    start = lambda j, s: stateful.clip_jobs_stream(j.drop("part"), s.drop("part"), late="1 second")
    got = rows(fed(spark, source, ready, ["part", "part"], start, analysis.CLIP, parts=7).where("id < 10000"))
    assert got == want


def test_visits_due_for_a_look(spark, sf_dir):
    detections = moving_detections(spark, sf_dir)
    told = tracking.visits(detections, tracking.Settings(due_seconds=0.4)).collect()
    plain = tracking.visits(detections).collect()
    assert sorted(map(str, [r for r in told if r["kind"] != "due"])) == sorted(map(str, plain))
    due = [r for r in told if r["kind"] == "due"]
    assert due and all(0 <= r[c] <= 1 for r in due for c in ("x1", "y1", "x2", "y2"))
    seen = spark.createDataFrame([("c", 0.0, "animal", 0.9, 0.2, 0.2, 0.4, 0.4), ("c", 0.2, "animal", 0.9, 0.22, 0.2, 0.42, 0.4), ("c", 2.2, "motion", 0.1, 0.9, 0.9, 1.0, 1.0), ("c", 2.1, "motion", 0.1, 0.9, 0.9, 1.0, 1.0)], "camera_id string, at double, label string, score double, x1 double, y1 double, x2 double, y2 double")
    [one] = [r for r in tracking.visits(seen, tracking.Settings(due_seconds=2.0)).collect() if r["kind"] == "due"]
    assert (one["at"], one["visit"]) == (2.2, 1) and one["x1"] > 0.22
