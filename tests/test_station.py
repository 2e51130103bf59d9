"""Requests, cameras, hub answers, outcomes in words, stores, streams to several sinks, stretches of recordings."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import clock
from trailmark.operators import ordered, station
from trailmark.operators.tracking import Camera
from trailmark.sources import files
from trailmark.streaming import pipeline


def test_requests_are_checked():
    assert station.request({}) == {"limit": 50, "newest_first": True, "camera": None, "label": None, "species": None, "window": None, "after": None, "before": None, "marked": False}
    asked = station.request({"limit": "500", "order": "asc", "label": "animal", "camera": "", "after_id": "7", "before_id": "", "window": "7d", "wrong": "1", "species": "Fox"})
    assert (asked["limit"], asked["newest_first"], asked["camera"], asked["after"], asked["before"], asked["marked"], asked["species"]) == (500, False, None, 7, None, True, "Fox")
    for bad in ({"limit": "0"}, {"limit": "501"}, {"limit": ""}, {"limit": "x"}, {"order": "up"}, {"order": ""}, {"label": "cat"}, {"after_id": "-1"}, {"before_id": "1.5"}, {"window": "2h"}):
        with pytest.raises(ValueError):
            station.request(bad)
    now = dt.datetime(2024, 1, 2, 3)
    assert station.day_asked_for("", "America/New_York", now) == station.day_asked_for(None, "America/New_York", now) == dt.date(2024, 1, 1)
    assert station.day_asked_for("2024-02-29", "UTC", now) == dt.date(2024, 2, 29)
    for bad in ("2023-02-29", "20240101", "2024-1-1", "today"):
        with pytest.raises(ValueError, match="YYYY-MM-DD"):
            station.day_asked_for(bad, "UTC", now)


def test_cameras_and_credentials(spark):
    rows = [("a", "stream", "h", True, "rtsp://x/1", None), ("b", "stream", None, True, "rtsp://x/1", None), ("c", "hub_clips", "h", False, None, None), ("d", "stream", "other", True, "rtsp://k:l@x/1", "file:///v.mp4"), ("e", "stream", "h", None, None, "rtsp://k:l@x/1")]
    cameras = spark.createDataFrame([(i, i, k, h, e, True, u, r, None) for i, k, h, e, u, r in rows], "id string, name string, kind string, hub string, enabled boolean, record boolean, detect_url string, record_url string, full_url string")
    hubs = spark.createDataFrame([("h", "u", "p")], "hub string, user string, password string")
    got = {r["id"]: (r["detect_url"], r["record_url"]) for r in station.with_hub_credentials(cameras, hubs).collect()}
    assert got == {"a": ("rtsp://u:p@x/1", None), "b": ("rtsp://x/1", None), "c": (None, None), "d": ("rtsp://k:l@x/1", "file:///v.mp4"), "e": (None, "rtsp://k:l@x/1")}
    assert {r["id"] for r in station.enabled(cameras).collect()} == {"a", "b", "d", "e"}
    woken = station.listed_cameras(cameras.withColumn("enabled", F.lit(True)), True).where("kind = 'hub_clips'").first()
    assert (woken["record"], woken["live"], woken["full"], woken["live_seconds"]) == (False, True, True, 120)
    asleep = station.listed_cameras(cameras.withColumn("enabled", F.lit(True)), False).where("kind = 'hub_clips'").first()
    assert (asleep["live"], asleep["full"], asleep["live_seconds"]) == (False, False, None)


def test_hub_answers_and_their_errors(spark):
    answers = [
        [{"code": 0, "value": {"n": 1}}],
        [{"code": 0}],
        [],
        {},
        [{"code": 1, "error": {"rspCode": -6, "detail": "please login first"}}],
        [{"code": 1, "error": {"rspCode": -7, "detail": "login failed", "auth_warning_info": {"unlock_time": 61, "remain_times": 0}}}],
        [{"code": 1, "error": {"rspCode": -7, "auth_warning_info": {"unlock_time": 0, "remain_times": 3}}}],
        [{"code": 1}],
    ]
    table = spark.createDataFrame([(json.dumps(a),) for a in answers], "v string")
    told = [r[0] for r in table.select(station.told_error(F.lit("Login"), F.col("v"))).collect()]
    assert told == [
        None,
        None,
        "Login: empty answer",
        "Login: empty answer",
        "Login: -6 please login first",
        "Login: -7 login failed; the account is locked for 2 more minutes",
        "Login: -7 unknown error; 3 attempts left before the Hub locks the account",
        "Login: 0 unknown error",
    ]
    fine = spark.createDataFrame([(json.dumps(a),) for a in answers[:2]], "v string")
    assert [r[0] for r in fine.select(station.first_value(F.lit("x"), F.col("v"))).collect()] == ['{"n":1}', None]
    with pytest.raises(Exception, match="please login first"):
        table.where("v like '%please%'").select(station.first_value(F.lit("x"), F.col("v"))).collect()


def test_words(spark):
    rows = [("named", "Red fox", "Vulpes vulpes", 0.876, None), ("not an animal", None, None, None, "person"), ("still unnamed", None, None, None, None), ("unknown", None, None, None, None), ("no animal", None, None, None, None)]
    d = spark.createDataFrame(rows, "o string, c string, s string, p double, l string")
    assert [r[0] for r in d.select(station.described(*map(F.col, "ocspl"))).collect()] == ["Red fox (Vulpes vulpes) 88 %", "not an animal, a person", "never moved and could not be named: motion", "no confident answer", "no animal found in the clip"]
    states = spark.createDataFrame([("Streaming",), ("Failed(no route)",), ("",)], "s string")
    assert [r[0] for r in states.select(station.state_name(F.col("s"))).collect()] == ["streaming", "failed", ""]


def test_midnights_that_are_missing_or_come_twice(spark):
    days = spark.createDataFrame([("2024-03-10",), ("2024-03-11",), ("2024-11-03",), ("2024-07-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert [r[0] for r in days.select(clock.local_midnight(F.col("d"), "America/Havana")).collect()] == [dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 11, 4), dt.datetime(2024, 11, 3, 4), dt.datetime(2024, 7, 1, 4)]


def test_stores_and_corpora(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    assert files.open_store(spark, at) == files.open_store(spark, at) == 1
    newer = f"file://{tmp_path}/newer"
    spark.range(1).select(F.lit(2).alias("version")).write.json(f"{newer}/meta")
    with pytest.raises(ValueError, match="version 2"):
        files.open_store(spark, newer)
    assert files.read_corpus(spark, f"file://{tmp_path}/none", "id long, label string").isEmpty()


def test_one_stream_to_several_sinks(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    sinks = {"even": (lambda s: s.where("id % 2 = 0"), str(tmp_path / "even")), "all": (lambda s: s, str(tmp_path / "all"))}
    for q in pipeline.split(stream, sinks, str(tmp_path / "state"), availableNow=True):
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "even")).count() == 10 and spark.read.parquet(str(tmp_path / "all")).count() == 20


def test_confirmed_things_explain_motion():
    camera = Camera()
    assert not camera.has_confirmed()
    for i in range(6):
        camera.frame(0.2 * i, ["animal"], [0.9], np.array([[0.1 + 0.02 * i, 0.1, 0.3 + 0.02 * i, 0.3]]))
    assert camera.has_confirmed()
    camera.lapse(100.0)
    assert not camera.has_confirmed()


def test_clips_do_not_mix_parameters(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    segments = [("k", day(1), "A"), ("k", day(2), "A"), ("k", day(3), "B"), ("k", day(4), None), ("k", day(5), "A")]
    frames = [("k", day(d, h), h == 0, day(d)) for d in range(1, 6) for h in (0, 6, 12)]
    windows = [(1, day(1, 7), day(4)), (2, day(2, 13), day(5)), (3, day(3, 1), day(9)), (4, day(9), day(10)), (5, day(4, 1), day(4, 7))]
    got = ordered.clip_rows_of_one_kind(
        spark.createDataFrame(frames, "k string, at timestamp_ntz, key_frame boolean, segment timestamp_ntz"),
        spark.createDataFrame(segments, "k string, segment timestamp_ntz, info string"),
        spark.createDataFrame([("k", *w) for w in windows], "k string, window_id long, from_at timestamp_ntz, to_at timestamp_ntz"),
        "k",
    )
    assert {r["window_id"]: (r["stretch"], r["first_at"], r["last_at"]) for r in got.collect()} == {
        1: (1, day(1), day(2, 12)),
        2: (2, day(3), day(3, 12)),
        3: (2, day(3), day(3, 12)),
        4: (4, day(5), day(5, 12)),
        5: (3, day(4), day(4, 6)),
    }


def test_rates_over_two_seconds_or_more(spark):
    ats = [0.0, 0.5, 1.0, 1.9, 2.1, 3.0, 4.0, 4.2, 9.0]
    rows = spark.createDataFrame([("c", i, t, 1_000) for i, t in enumerate(ats)], "k string, id long, at double, bytes long")
    got = [(r["ended_at"], r["n"], round(r["fps"], 6), round(r["kbps"], 6)) for r in ordered.measured(rows, "k").orderBy("ended_at").collect()]
    assert got == [(2.1, 4, round(4 / 2.1, 6), round(32 / 2.1, 6)), (4.2, 3, round(3 / 2.1, 6), round(24 / 2.1, 6)), (9.0, 1, round(1 / 4.8, 6), round(8 / 4.8, 6))]
