"""Ordered computations cut into slots, against plain walks; one key with all rows is many tasks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import carried


def test_runs_go_on_over_slots_without_rows(spark):
    rng = random.Random(1)
    at, rows = dt.datetime(2024, 1, 1), []
    for key in ("a", "b", None):
        now = at
        for _ in range(400):
            now += dt.timedelta(minutes=rng.choice([0, 1, 5, 19, 20, 21, 60, 60 * 40]))
            rows.append((key, now))
    got = {(r[0], r["run"]): (r["run_start"], r["run_end"], r["n"]) for r in carried.sessions(spark.createDataFrame(rows, "k string, at timestamp_ntz"), "k", "at", "20 minutes").collect()}
    want, last = {}, {}
    for key, now in rows:
        run, end = last.get(key, (0, None))
        run += end is None or now - end > dt.timedelta(minutes=20)
        last[key] = (run, now)
        start, _, n = want.get((key, run), (now, now, 0))
        want[key, run] = (start, now, n + 1)
    assert got == want
    long = carried.sessions(spark.createDataFrame(rows, "k string, at timestamp_ntz"), "k", "at", "50 hours").where("k = 'a'")
    assert long.count() == 1 and long.first()["n"] == 400


def test_clocks_over_slots(spark):
    rng = random.Random(2)
    steps = [rng.choice([5, 2**31 - 1, -7, 2**20, -(2**31)]) for _ in range(500)]
    true = [2**32 - 10]
    for s in steps:
        true.append(true[-1] + s)
    rows = spark.createDataFrame([("k", i, v % 2**32) for i, v in enumerate(true)] + [(None, 0, 3)], "k string, i long, c long")
    got = [r["unwrapped"] for r in carried.unwrapped(rows, "k", "i", "c", F.floor(F.col("i") / 7)).where("k is not null").orderBy("i").collect()]
    assert got == true


def test_composed_maps_like_a_plain_walk(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, 0.95, 0.5, 0.0, 1.0]), rng.uniform(-9, 9)) for k in ("x", "y", None) for i in range(700) if rng.random() < 0.8]
    table = spark.createDataFrame(rows, "k string, i long, a double, b double")
    got = {(r["k"], r["i"]): r["after"] for r in carried.composed(table, "k", ["i"], F.floor(F.col("i") / 50), F.col("a"), F.col("b"), 4.0).collect()}
    y, want = {}, {}
    for k, i, a, b in rows:
        y[k] = y.get(k, 4.0) if a is None else a * y.get(k, 4.0) + b
        want[k, i] = y[k]
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_one_key_is_cut_into_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("hot").alias("camera_id"), F.col("id").alias("seq"), (F.col("id") * 3000).alias("ts90"))
    n = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(n)
    spark.conf.set(n, "false")
    try:
        walked = carried.composed(rows, "camera_id", ["seq"], F.floor(F.col("seq") / 4096), F.lit(0.95), F.lit(1.0))
        parts = walked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set(n, before)
    # 49 slots over 8 partitions: no task has the key's rows.
    assert len(parts) >= 6 and max(r["n"] for r in parts) < 100_000


def test_live_frames_and_decoding_times(spark):
    ts = [0, 3000, 6100, 6100, 50_000, 200_000, 203_000]
    units = spark.createDataFrame([("c", i, t, i in (2, 5), float(i)) for i, t in enumerate(ts)], "camera_id string, seq long, ts90 long, key_frame boolean, ms double")
    got = carried.frame_durations(units).orderBy("seq").collect()
    average, want, at = 3000.0, [], 0
    for i, t in enumerate(ts):
        step = t - ts[i - 1] if i else 0
        average += 0.05 * (step - average) if 1 <= step <= 45_000 else 0
        want.append((int(average + 0.5), at))
        at += int(average + 0.5)
    assert [(r["duration"], r["decode_time"]) for r in got] == want
    means = carried.decode_means(units).orderBy("seq").collect()
    assert [r["seq"] for r in means] == [2, 3, 4, 5, 6]
    assert [r["mean_ms"] for r in means][:2] == [2.0, pytest.approx(2.05)]


@pytest.mark.parametrize(("every", "share", "most"), [(1.0, 0.9, None), (0.05, 1.0, None), (3.0, 1.0, 4), (0.0, 1.0, None), (1_000.0, 1.0, None)])
def test_throttles_like_a_plain_walk(spark, every, share, most):
    rng = random.Random(5)
    rows = []
    for k in ("x", "y", None):
        at = -3.0
        for i in range(900):
            at += rng.choice([0.0, 0.01, 0.1, 0.3, 0.9, 0.45]) if rng.random() < 0.995 else rng.choice([40.0, 130.0])
            rows.append((k, i, round(at, 2)))
    table = spark.createDataFrame([*rows, ("x", 5_000, None)], "k string, id long, at double")
    got = {(r["k"], r["id"]) for r in carried.throttled(table, "k", every, share, most).collect()}
    want, last, n = set(), {}, {}
    for k, i, at in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        if (k not in last or at - last[k] >= share * every) and (most is None or n.get(k, 0) < most):
            want.add((k, i))
            last[k], n[k] = at, n.get(k, 0) + 1
    assert got == want
    assert carried.throttled(table.limit(0), "k", every, share, most).isEmpty()


def test_all_rows_of_a_throttle_hold_what_was_kept_before_them(spark):
    """Keys without a value and long ones stay as they are; a slot may have rows of which none is kept."""
    rng = random.Random(7)
    rows = []
    for k in (2**60 + 1, 2**60 + 2, None):
        at = 0.0
        for i in range(600):
            at += rng.choice([0.0, 0.3, 0.9]) if rng.random() < 0.9 else rng.choice([60.3, 64.0])
            rows.append((k, i, round(at, 2)))
    table = spark.createDataFrame([*rows, (None, 5_000, None)], "k long, id long, at double")
    got = {(r["k"], r["id"]): (r["__kept"], r["__before"], r["__from"]) for r in carried.passed(table, "k", 1.0).collect()}
    want, last, n, slots, kept_slots = {}, {}, {}, set(), set()
    for k, i, at in rows:
        keeps = k not in last or at - last[k] >= 1.0
        want[k, i] = (keeps, n.get(k, 0), last.get(k))
        slots.add((k, at // carried.SLOT))
        if keeps:
            last[k], n[k] = at, n.get(k, 0) + 1
            kept_slots.add((k, at // carried.SLOT))
    assert got == want and slots - kept_slots
    assert {(r["k"], r["id"]) for r in carried.throttled(table, "k", 1.0, 1.0).collect()} == {at for at, (keeps, *_) in want.items() if keeps}
