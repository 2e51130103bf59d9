"""Edge rules of motion events and of what hubs and streams say of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import motion, retention, species

FRAME = "camera_id string, id long, at_ms long, moving boolean, area double, objects boolean"


def events(spark, rows, **limits):
    frames = spark.createDataFrame([(c, i, *r) for i, (c, *r) in enumerate(rows)], FRAME)
    return sorted(tuple(r) for r in motion.motion_events(frames, **limits).collect())


def test_short_and_broken_runs_open_nothing(spark):
    assert events(spark, []) == []
    assert events(spark, [("a", t, True, 0.1, False) for t in range(0, 3_000, 500)]) == []
    # A pause over a second begins a new run, one of a second doesn't.
    assert events(spark, [("a", t, True, 0.1, False) for t in (0, 1_000, 2_000, 3_001, 4_001, 5_001)]) == []
    assert events(spark, [("a", t, True, 0.1, False) for t in (0, 1_000, 2_000, 3_000)]) == [("a", 1, 0, 3_000, 0)]


def test_events_end_by_quiet_frames_and_by_objects_and_cool_down(spark):
    run = lambda start: [("a", start + t, True, 0.1 + t / 1e5, False) for t in range(0, 4_000, 1_000)]
    still = lambda t: ("a", t, False, None, None)
    # Quiet for five seconds isn't over five seconds; the second run falls into the cooldown, the third doesn't.
    got = events(spark, [*run(0), still(8_000), still(8_001), *run(10_000), *run(20_000)], cooldown=14_999)
    assert got == [("a", 1, 0, 3_000, 3_000), ("a", 2, 20_000, 23_000, 23_000)]
    assert events(spark, [*run(0), still(8_000), *run(10_000)]) == [("a", 1, 0, 13_000, 3_000)]
    seen = ("a", 3_500, True, 0.9, True)
    assert events(spark, [*run(0), seen, *run(4_000)], cooldown=0) == [("a", 1, 0, 3_000, 3_000), ("a", 2, 4_000, 7_000, 7_000)]


def test_long_motion_is_split_without_a_cooldown_and_cameras_are_apart(spark):
    rows = [(c, t, True, 0.1, False) for t in range(0, 9_000, 1_000) for c in ("a", "b")] + [(None, 0, True, 0.1, False), ("a", None, True, 0.1, False)]
    want = [(1, 0, 4_000, 0), (2, 4_000, 8_000, 4_000), (3, 8_000, 8_000, 8_000)]
    assert events(spark, rows, longest=4_000) == [(c, *w) for c in ("a", "b") for w in want]


def test_codec_names(spark):
    hvc = bytes([1, 1, 0x60, 0, 0, 0, 0xB0, 0, 0, 0, 0, 0, 153])
    tier = bytes([1, 0x60 | 2, 0, 0, 0, 1, 0, 0x0A, 0, 0, 0, 0, 90])
    rows = [("h265", hvc), ("h265", tier), ("h265", hvc[:12]), ("h264", bytes([1, 0x64, 0, 0x1F])), ("h264", b"abc"), ("vp9", hvc), ("h264", None), (None, hvc)]
    df = spark.createDataFrame(rows, "codec string, config binary").select(motion.codec_string(F.col("codec"), F.col("config")).alias("name"))
    assert [r["name"] for r in df.collect()] == ["hvc1.1.6.L153.B0", "hvc1.A2.80000000.H90.0.A", None, "avc1.64001f", None, None, None, None]


def test_channels_of_odd_answers(spark):
    rows = [('{"status": [{"channel": 0, "online": 1}, {"name": "lost"}, {"channel": 3, "name": "yard", "sleep": 1, "more": []}]}',), ('{"status": []}',), ("{}",), ("no JSON",), (None,)]
    got = spark.createDataFrame(rows, "said string").select(motion.hub_channels(F.col("said")).alias("c")).collect()
    assert [[tuple(c) for c in r["c"]] for r in got] == [[(0, "", True, False), (3, "yard", False, True)], [], [], [], []]


def test_crops_patches_and_ledgers(spark):
    crops = spark.createDataFrame([(1, 1, "animal", 0.5, False), (1, 2, "animal", 0.5, True), (1, 3, "animal", 0.9, False), (1, 4, "person", 0.99, True), (2, 5, "person", 0.9, True)], "clip long, crop long, label string, quality double, moved boolean")
    assert sorted((r["place"], r["crop"], r["moved"]) for r in motion.best_crops(crops, "clip", 2).collect()) == [(1, 3, True), (2, 1, True)]
    rows = spark.createDataFrame([("named", "fox", None), ("not an animal", None, "person"), ("still unnamed", None, "motion"), ("unknown", None, None), ("no animal", None, None)], "o string, n string, l string")
    got = [r["p"] and tuple(r["p"]) for r in rows.select(species.patch(F.col("o"), F.col("n"), F.col("l")).alias("p")).collect()]
    assert got == [(None, "fox"), ("person", None), ("motion", None), None, None]
    log = spark.createDataFrame([("h", "a", 7, 1), ("h", "a", None, 2), ("h", "b", None, 1), ("h", "b", 9, 2)], "hub string, file string, event_id long, seq long")
    assert sorted(tuple(r) for r in retention.ledger(log, "seq").select("file", "event_id").collect()) == [("a", -1), ("b", 9)]


def test_answers_of_cameras_in_xml(spark):
    say = lambda body: f'<e:Envelope xmlns:e="e"><e:Body>{body}</e:Body></e:Envelope>'
    one = say('<x:GetProfilesResponse xmlns:x="m"><x:Profiles token="p"><Name>main</Name><VideoEncoderConfiguration token="q"><Resolution><Width>wide</Width><Height>720</Height></Resolution></VideoEncoderConfiguration></x:Profiles></x:GetProfilesResponse>')
    sizes = say("<GetVideoEncoderConfigurationOptionsResponse><Options><MPEG4><ResolutionsAvailable><Width>8</Width><Height>6</Height></ResolutionsAvailable><ResolutionsAvailable><Width>8</Width></ResolutionsAvailable></MPEG4><AV1/></Options></GetVideoEncoderConfigurationOptionsResponse>")
    rows = [(one,), (sizes,), (say(""),), ("no XML",), (None,)]
    got = spark.createDataFrame(rows, "said string").select(motion.camera_profiles(F.col("said")).alias("p"), motion.allowed_sizes(F.col("said")).alias("s")).collect()
    assert [[tuple(p) for p in r["p"] or []] for r in got] == [[("p", "main", "", "", 0, 720, None, None, "q")], [], [], [], []]
    assert [[tuple(s) for s in r["s"]] for r in got] == [[], [("MPEG4", 8, 6)], [], [], []]


def test_an_answer_is_read_once_for_all_codecs(spark):
    plan = spark.range(1).select(motion.allowed_sizes(F.lit("<a/>")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_xml(") == 1
