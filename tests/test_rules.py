"""Edge rules of the sighting engine that the oracles' tables don't reach."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailmark.functions import clock, geometry, text
from trailmark.operators import carried, joins, listing, ordered, retention, species, stats


def test_limits_and_windows_are_refused(spark):
    events = spark.createDataFrame([(1,)], "id long")
    for limit in (0, 501):
        with pytest.raises(ValueError):
            listing.page(events, limit)
    with pytest.raises(ValueError):
        listing.window_start("2h", "2024-01-01 00:00:00")


def test_unknown_labels_stop_a_query(spark):
    with pytest.raises(Exception, match="unknown label cat"):
        spark.createDataFrame([("cat",)], "l string").select(text.label_or_error(F.col("l"), ("person",))).collect()


def test_species_fold_by_unicode_and_filters_by_ascii(spark):
    rows = [(1, "c", "animal", "ÄLK", None, dt.datetime(2024, 1, 1), 0.5, 0.9, "ready"), (2, "c", "animal", "älk", "Alces", dt.datetime(2024, 1, 2), 0.5, 0.95, "failed")]
    events = spark.createDataFrame(rows, "id long, camera_id string, label string, common_name string, scientific_name string, started_at timestamp_ntz, top_score double, species_score double, clip_state string")
    [one] = stats.by_species(events).collect()
    assert (one["n"], one["common_name"], one["best_id"], one["scientific_name"]) == (2, "ÄLK", 1, None)
    assert listing.matching(events, species="älk").count() == 1


def test_best_event_needs_a_higher_score_and_a_ready_clip(spark):
    rows = [(1, 0.5, "failed"), (2, 0.9, "failed"), (3, 0.6, "ready"), (4, 0.6, "ready"), (5, 0.5, "ready")]
    events = spark.createDataFrame([(i, "animal", "fox", "V", dt.datetime(2024, 1, i), 0.1, s, c) for i, s, c in rows], "id long, label string, common_name string, scientific_name string, started_at timestamp_ntz, top_score double, species_score double, clip_state string")
    assert stats.by_species(events).first()["best_id"] == 3


def test_daylight_saving_hours(spark):
    rows = spark.createDataFrame([("2026-11-01 05:30:00",), ("2026-11-01 06:30:00",), ("2026-11-01 04:30:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in rows.select(F.hour(clock.local(F.col("t"), "America/New_York"))).collect()] == [1, 1, 0]
    assert rows.select(clock.local_midnight(F.lit("2026-11-01").cast("date"), "America/New_York")).first()[0] == dt.datetime(2026, 11, 1, 4)


def test_urls_hide_secrets(spark):
    given = ["rtsp://u:p@h/a?Token=x&b=1", "rtsp://a@b@h/x", "file:///x?password=1", "no url?key=2", "http://h/?user=1#token=2"]
    rows = spark.createDataFrame([(u,) for u in given], "u string")
    assert [r[0] for r in rows.select(text.redacted(F.col("u"))).collect()] == ["rtsp://***@h/a?Token=***&b=1", "rtsp://***@h/x", "file:///x?password=***", "no url?key=***", "http://h/?user=***"]
    one = rows.limit(1).select(text.user_info(F.lit("rtsp://u:p@h/")).alias("i"), text.without_credentials(F.lit("rtsp://u:p@h/")).alias("b"), text.with_credentials(F.lit("rtsp://h/"), F.lit("a b"), F.lit("@")).alias("w")).first()
    assert tuple(one) == ("u:p", "rtsp://h/", "rtsp://a%20b:%40@h/")


def test_tiles_cover_a_picture():
    assert geometry.tiles(640, 640) == [(0, 0, 640)]
    assert geometry.tiles(1536, 432) == [(0, 0, 432), (368, 0, 432), (736, 0, 432), (1104, 0, 432)]
    assert geometry.tiles(300, 500) == [(0, 0, 300), (0, 200, 300)]


def test_pixels_there_and_back(spark):
    row = spark.createDataFrame([(101, 51, 33, 700)], "x int, y int, w int, h int")
    x, y, w, h = (F.col(c) for c in "xywh")
    assert tuple(row.select(*geometry.aligned(x, y, w, h, 640, 360)).first()) == (100, 50, 32, 310)
    assert tuple(row.select(*geometry.of_pixels(x, y, w, h, 1000, 100).columns()).first()) == (0.101, 0.51, 0.134, 7.51)
    fit = geometry.letterbox(640, 360, 320)
    assert fit == (0.5, 0.0, 70.0)
    assert tuple(row.select(*geometry.from_letterbox(*geometry.to_letterbox(x, y, fit), fit)).first()) == (101.0, 51.0)


def test_patches_keep_set_and_clear(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, path string")
    patches = spark.createDataFrame([(1, 1, (True, "x")), (1, 2, (False, None)), (2, 1, (True, "y")), (2, 2, (True, None)), (9, 1, (True, "z"))], "id long, seq int, path struct<is_set:boolean,value:string>")
    assert {r["id"]: r["path"] for r in retention.patched(events, patches, ["path"]).collect()} == {1: "x", 2: None, 3: None}


def test_geofence_rules(spark):
    rules = spark.createDataFrame([("a", {}, {}), ("b", {"US": []}, {}), ("c", {"US": ["NY"]}, {}), ("d", {"CA": []}, {}), ("e", {}, {"US": []}), ("f", {}, {"US": ["NY"]}), ("g", {}, {"US": ["NJ"]})], "taxon string, allow map<string,array<string>>, block map<string,array<string>>")
    out = lambda *at: {r[0] for r in species.blocked(rules, *at).collect()}
    assert out("US", "NY") == {"d", "e", "f"}
    assert out("US", "NJ") == {"c", "d", "e", "g"}
    assert out("US", None) == {"d", "e"}
    assert out(None, None) == set()


def test_overlaps_are_strict_and_come_once(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    windows = spark.createDataFrame([(1, "c", at(10), at(20))], "id long, camera_id string, from_at timestamp_ntz, to_at timestamp_ntz")
    segments = spark.createDataFrame([("c", 1, at(0), at(10)), ("c", 2, at(1), at(10.5)), ("c", 3, at(9), at(40)), ("c", 4, at(20), at(21)), ("c", 5, at(-1), at(30)), ("d", 6, at(12), at(13)), ("c", 7, at(12), at(13))], "camera_id string, segment_id long, seg_start timestamp_ntz, seg_end timestamp_ntz")
    assert sorted(r["segment_id"] for r in joins.overlapping(windows, segments).collect()) == [2, 3, 7]


def test_throttle_compares_with_the_last_kept_frame(spark):
    rows = spark.createDataFrame([("c", i, 0.4 * i) for i in range(10)], "key string, id long, at double")
    assert [r["id"] for r in carried.throttled(rows, "key", 1.0).orderBy("id").collect()] == [0, 3, 6, 9]


def test_nearest_rank_is_not_interpolated(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 41)], "k string, v double")
    assert ordered.nearest_rank(rows, "k", "v").first()["p"] == 39.0


def test_clock_wraps(spark):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate([2**32 - 10, 5, 2, 2**31])], "k string, i long, c long")
    assert [r["unwrapped"] for r in carried.unwrapped(rows, "k", "i", "c", F.col("i") % 1 + F.floor(F.col("i") / 2)).orderBy("i").collect()] == [2**32 - 10, 2**32 + 5, 2**32 + 2, 2**32 + 2**31]


def test_marks_correct_animals(spark):
    rows = [(1, "animal", None, None, "fox", "V"), (2, "animal", "nothing", None, "fox", "V"), (3, "person", "animal", None, None, None), (4, "vehicle", "animal", "Moose", None, None), (5, "animal", "animal", None, None, None), (6, "animal", "motion", None, "fox", "V")]
    events = spark.createDataFrame([(i, lab, f, s, c, n, dt.datetime(2024, 1, 1), 3) for i, lab, f, s, c, n in rows], "id long, label string, feedback string, feedback_species string, common_name string, scientific_name string, started_at timestamp_ntz, local_hour int")
    assert {r["id"]: r["animal"] for r in stats.corrected(events).collect()} == {1: "fox", 3: None, 4: "Moose", 5: None}
    assert tuple(stats.unidentified(events).first()) == (2, 4)


def test_objects_of_overlapping_regions_are_merged(spark):
    rows = [
        (1, 1, "person", 0.9, 0.1, 0.1, 0.5, 0.5),
        (1, 2, "person", 0.8, 0.3, 0.1, 0.6, 0.5),  # half of it inside the first: by IoU neither
        (1, 3, "person", 0.7, 0.15, 0.15, 0.3, 0.3),  # inside the first
        (1, 4, "animal", 0.6, 0.1, 0.1, 0.5, 0.5),  # the first's place by another label
        (1, 5, "animal", 0.5, 0.7, 0.7, 0.9, 0.9),
        (2, 1, "person", 0.5, 0.0, 0.0, 0.2, 0.2),
    ]
    table = spark.createDataFrame(rows, "frame long, det int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["frame"], r["det"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in joins.merged_regions(table).collect()}
    # 0.08 of the second's 0.12 is inside the first, more than 60 %: it widens it.
    assert got == {(1, 1): (0.1, 0.1, 0.6, 0.5), (1, 5): (0.7, 0.7, 0.9, 0.9), (2, 1): (0.0, 0.0, 0.2, 0.2)}


def test_segments_begin_with_key_frames(spark):
    # Ten packets a second, a key frame each second but the first packet, two cameras.
    rows = [(c, i * 100_000 + 7, i * 9000, i % 10 == 3, 10) for c in ("a", "b") for i in range(60)]
    got = sorted(map(tuple, ordered.recorded(spark.createDataFrame(rows, "camera_id string, arrived_us long, ts90 long, key_frame boolean, size long"), 2).collect()))
    want = [(c, s * 100_000 + 7, e * 100_000 + 7, e - s, 10 * (e - s)) for c in ("a", "b") for s, e in ((3, 23), (23, 43), (43, 60))]
    assert got == want


def test_a_clock_that_drifts_is_anchored_anew(spark):
    rows = [("a", i * 100_000 + (900_000 if i >= 5 else 0), i * 9000, i == 0, 1) for i in range(10)]
    [one] = ordered.recorded(spark.createDataFrame(rows, "camera_id string, arrived_us long, ts90 long, key_frame boolean, size long"), 60).collect()
    assert (one["started_us"], one["ended_us"], one["n"]) == (0, 1_900_000, 10)


def test_clip_rows_against_brute_force_and_for_every_event(spark, sf_dir):
    import __spark_entry__

    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    frames = [("a", at(h), h % 9 == 4) for h in range(0, 200, 5)] + [("b", at(7), False), ("c", None, True)]
    windows = [(k, 100 * n + h, at(h), at(h + 30)) for n, k in enumerate("abcd") for h in (-60, 0, 4, 5, 40, 41, 190, 400)] + [("a", 999, None, None)]
    f = spark.createDataFrame(frames, "k string, at timestamp_ntz, key_frame boolean")
    w = spark.createDataFrame(windows, "k string, window_id long, from_at timestamp_ntz, to_at timestamp_ntz")
    want = {}
    for k, i, start, end in windows:
        own = [(t, key) for x, t, key in frames if x == k]
        if own:
            keys = [t for t, key in own if key and t]
            early = [t for t in keys if start and t <= start]
            want[k, i] = (max(early) if early else min(keys, default=None), max((t for t, _ in own if t and end and t <= end), default=None))
    assert {(r["k"], r["window_id"]): (r["first_at"], r["last_at"]) for r in ordered.clip_rows(f, w, "k").collect()} == want
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert __spark_entry__.queries()["wn_clip_rows_all"](spark, sf_dir).count() == events


def test_spots_of_the_whole_page_of_marks(spark, sf_dir):
    from trailmark.sources.adapter import sightings

    events = sightings(spark, sf_dir.rsplit("/", 1)[0] + "/sf0.01")
    few, page = ({r["id"] for r in joins.in_marked_spot(events, newest=n).collect()} for n in (5, 500))
    assert few < page


def test_assumptions_are_checked(spark):
    from trailmark.sources.adapter import taxonomy

    known = taxonomy(spark)
    assert species.resolve_assume({" genus4": "Kind 17"}, known) == {"class0;order1;family2;genus4": "class0;order1;family2;genus4;species17"}
    for group, name in (("nothing", "kind 17"), ("genus3", "nothing"), ("genus3", "kind 17")):
        with pytest.raises(ValueError):
            species.resolve_assume({group: name}, known)


def test_password_digest(spark):
    nonce = F.unbase64(F.lit("LKqI6G/AikKCQrN0zqZFlg=="))
    row = spark.range(1).select(text.password_digest(nonce, F.lit("2010-09-16T07:50:45Z"), F.lit("userpassword")).alias("d"), text.from_hex(F.lit("abc")).alias("odd")).first()
    assert row["d"] == "tuOSpGlFlIXsozq4HFNeeGeFLEI=" and row["odd"] is None


def test_ranks_of_ties_and_single_values(spark):
    rows = [("a", float(v)) for v in (1, 1, 1, 1, 9)] + [("b", 3.0), ("c", None)] + [("d", float(i % 37)) for i in range(1000)] + [(None, 2.0)]
    got = {r["k"]: (r["p"], r["n"]) for r in ordered.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", 95).collect()}
    want = sorted(float(i % 37) for i in range(1000))[950]
    assert got == {"a": (9.0, 5), "b": (3.0, 1), "d": (want, 1000), None: (2.0, 1)}
