"""Cases in which the rules of decisions, marks, evaluation, recordings and retention differ from plainer ones."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trailmark.operators import evaluate, ordered, retention, species, stats
from trailmark.sources import files

AT = dt.datetime(2024, 1, 1)


def minutes(n):
    return AT + dt.timedelta(minutes=n)


# A small taxonomy: a deer genus with two species, a fox genus with one, another genus of the fox's family.
TAXA = [
    (0, "", "", "", "", "", "blank"),
    (1, "mammalia", "primates", "hominidae", "homo", "sapiens", "human"),
    (2, "mammalia", "artiodactyla", "cervidae", "odocoileus", "virginianus", "white-tailed deer"),
    (3, "mammalia", "artiodactyla", "cervidae", "odocoileus", "hemionus", "mule deer"),
    (4, "mammalia", "carnivora", "canidae", "vulpes", "vulpes", "red fox"),
    (5, "mammalia", "carnivora", "canidae", "canis", "latrans", "coyote"),
    (6, "mammalia", "carnivora", "canidae", "canis", "", "canis species"),
    (7, "mammalia", "carnivora", "canidae", "canis", "lupus", "wolf"),
]
KEY = {i: ";".join(x for x in t[:5] if x) for i, *t in TAXA}
DEER, CANIS, DOGS = "mammalia;artiodactyla;cervidae;odocoileus", "mammalia;carnivora;canidae;canis", "mammalia;carnivora;canidae"


@pytest.fixture(scope="module")
def taxa(spark):
    return spark.createDataFrame(TAXA, "class int, t_class string, t_order string, t_family string, t_genus string, t_species string, common string")


def decided(spark, taxa, probs, out=(), detector=0.9, assume=None, narrow=True):
    votes = spark.createDataFrame([(1, i, p) for i, p in probs.items()], "event long, class int, p double")
    kept_out = spark.createDataFrame([(k,) for k in out], "taxon string")
    scores = spark.createDataFrame([(1, detector)], "event long, detector_score double")
    [row] = species.decide(votes, taxa, kept_out, 0.5, scores, assume=assume, narrow=narrow).collect()
    return row["how"], row["name"], row["score"]


def test_a_species_needs_certainty_or_a_detector_that_agrees(spark, taxa):
    assert decided(spark, taxa, {4: 0.85, 5: 0.1}, detector=0.1) == ("species", KEY[4], 0.85)
    assert decided(spark, taxa, {4: 0.6, 5: 0.3}, detector=0.3) == ("species", KEY[4], 0.6)
    # The detector isn't sure: no genus adds up to more than the top class, so its own genus is the first above 0.5.
    assert decided(spark, taxa, {4: 0.6, 5: 0.3}, detector=0.2, narrow=False) == ("group", "mammalia;carnivora;canidae;vulpes", 0.6)
    assert decided(spark, taxa, {2: 0.4, 3: 0.3, 4: 0.1}, narrow=False) == ("group", DEER, 0.7)
    assert decided(spark, taxa, {2: 0.2, 4: 0.2, 0: 0.6}) == (None, None, None)
    assert decided(spark, taxa, {1: 0.9, 4: 0.1}) == (None, None, None)


def test_a_species_kept_out_gives_way_to_the_local_one_or_a_higher_group(spark, taxa):
    assert decided(spark, taxa, {3: 0.9, 2: 0.05}, [KEY[3]]) == ("local", KEY[2], 0.9)
    # No single local species: from the family on, and as probable as the top class.
    assert decided(spark, taxa, {5: 0.9, 7: 0.05, 4: 0.05}, [KEY[5], KEY[7]]) == ("group", DOGS, 1.0)
    assert decided(spark, taxa, {5: 0.9}, [KEY[5], KEY[7]]) == ("group", DOGS, 0.9)
    assert decided(spark, taxa, {5: 0.9, 4: 0.05}, [KEY[5], KEY[7], DOGS]) == ("group", "mammalia;carnivora", 0.95)


def test_assumed_species_count_before_local_ones(spark, taxa):
    wolf = {CANIS: KEY[7]}
    assert decided(spark, taxa, {5: 0.9}, [KEY[5], KEY[7]], assume=wolf) == ("local", KEY[7], 0.9)
    assert decided(spark, taxa, {5: 0.3, 7: 0.3}, assume=wolf) == ("group", KEY[7], 0.6)
    assert decided(spark, taxa, {6: 0.9}, assume=wolf) == ("species", KEY[7], 0.9)
    assert decided(spark, taxa, {6: 0.9}) == ("species", CANIS, 0.9)
    assert decided(spark, taxa, {6: 0.9}, [KEY[5]]) == ("species", KEY[7], 0.9)
    # An assumption for a family reaches its genera, the nearest one first.
    assert decided(spark, taxa, {5: 0.3, 7: 0.3}, assume={DOGS: KEY[4]}) == ("group", KEY[4], 0.6)
    assert decided(spark, taxa, {5: 0.3, 7: 0.3}, assume={DOGS: KEY[4], **wolf}) == ("group", KEY[7], 0.6)


def test_a_mark_without_species_leaves_an_animal_unnamed(spark):
    rows = [(1, "animal", "animal", None, "fox", "V"), (2, "animal", "animal", "Moose", "fox", "V"), (3, "animal", None, None, "Fox", "V"), (4, "person", "animal", "fox", None, None)]
    events = spark.createDataFrame([(i, lab, f, s, c, n, minutes(i), 3) for i, lab, f, s, c, n in rows], "id long, label string, feedback string, feedback_species string, common_name string, scientific_name string, started_at timestamp_ntz, local_hour int")
    assert {r["id"]: (r["animal"], r["animal_scientific"]) for r in stats.corrected(events).collect()} == {1: (None, None), 2: ("Moose", ""), 3: ("Fox", "V"), 4: ("fox", "")}
    assert tuple(stats.unidentified(events).first()) == (1, 4)
    assert {r["key"]: (r["n"], r["scientific_name"], r["animal"]) for r in stats.tally(events).collect()} == {"moose": (1, "", "Moose"), "fox": (2, "V", "Fox")}


def test_what_a_mark_rules_out_must_be_gone(spark):
    cases = [
        # label, name, feedback, its species, found, passed, passed without names
        ("person", None, "animal", "fox", [("animal", "red fox")], True, True),
        ("person", None, "animal", "fox", [("animal", "red fox"), ("person", None)], False, False),
        ("motion", None, "animal", None, [("animal", None), ("motion", None)], True, True),
        ("animal", "Deer", "animal", None, [("animal", "white-tailed deer")], False, True),
        ("animal", "Deer", "animal", None, [("animal", "fox")], True, True),
        ("animal", "Deer", "animal", None, [("animal", None)], True, True),
        ("animal", "Deer", "animal", "fox", [("animal", "deer")], False, True),
        ("animal", "Deer", None, None, [("animal", None)], False, True),
        ("animal", "Deer", "motion", None, [("motion", None)], True, True),
        ("animal", "Deer", "nothing", None, [("animal", "Deer")], False, False),
        ("motion", None, None, None, [], True, True),
        ("vehicle", None, None, None, [("person", None)], False, False),
    ]
    events = spark.createDataFrame([(i, "c", f is not None, lab, n, f, s) for i, (lab, n, f, s, *_) in enumerate(cases)], "id long, camera_id string, marked boolean, label string, common_name string, feedback string, feedback_species string")
    findings = spark.createDataFrame([(i, *x) for i, c in enumerate(cases) for x in c[4]], "id long, label string, name string")
    for named, at in ((True, 5), (False, 6)):
        assert {r["id"]: r["passed"] for r in evaluate.judged(events, findings, named).collect()} == {i: c[at] for i, c in enumerate(cases)}


def test_tracks_of_a_recording_become_one_event_of_each_label(spark):
    rows = [
        (1, 1, "motion", 0, 9, 0.0, 0.0, False, []),
        (1, 2, "animal", 2, 5, 0.6, 0.5, False, [(0.9, 20), (0.1, 21)]),
        (1, 3, "animal", 1, 4, 0.8, 0.7, True, [(0.5, 30), (0.95, 31)]),
        (1, 4, "animal", 0, None, 0.4, 0.3, True, [(1.0, 40)]),
        (1, 5, "person", 3, 6, 0.8, 0.7, False, []),
        (2, 6, "motion", 0, 1, 0.0, 0.0, False, [(0.5, 60)]),
        (2, 7, "motion", 2, 3, 0.0, 0.0, False, []),
        (3, 8, "animal", 2, None, 0.9, 0.8, False, [(0.5, 80)]),
        (3, 9, "animal", 1, 4, 0.8, 0.7, True, [(0.7, 90)]),
    ]
    at = lambda m: None if m is None else minutes(m)
    tracks = spark.createDataFrame([(r, i, lab, at(s), at(e), t, m, mv, c) for r, i, lab, s, e, t, m, mv, c in rows], "recording long, id long, label string, started_at timestamp_ntz, ended_at timestamp_ntz, top_score double, median_score double, moved boolean, crops array<struct<quality:double,crop:long>>")
    got = {r["id"]: (r["recording"], r["label"], r["started_at"], r["ended_at"], r["top_score"], r["median_score"], r["moved"], r["crops"]) for r in ordered.merged_recordings(tracks, 3).collect()}
    assert got == {
        3: (1, "animal", minutes(1), minutes(5), 0.8, 0.7, True, [31, 20, 30]),
        5: (1, "person", minutes(3), minutes(6), 0.8, 0.7, False, []),
        6: (2, "motion", minutes(0), minutes(1), 0.0, 0.0, False, [60]),
        7: (2, "motion", minutes(2), minutes(3), 0.0, 0.0, False, []),
        8: (3, "animal", minutes(1), None, 0.9, 0.8, False, [80]),
    }


def test_retention_goes_by_the_instant_and_by_every_clip(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [
        # id, began, state, clip, bytes, sharp, feedback
        (1, day(1, 11), "ready", "a", 10, None, None),
        (2, day(1, 13), "ready", "b", 10, None, None),
        (3, day(1, 2), "purged", None, None, None, None),
        (4, day(1, 3), "purged", None, None, "s", None),
        (5, day(1, 4), "ready", "e", 10, None, "nothing"),
        (6, day(5), "failed", "f", None, None, None),
        (7, day(6), "pending", "g", 10, None, None),
        (8, day(1, 5), "failed", None, None, None, None),
    ]
    events = spark.createDataFrame([(i, at, s, c, b, None, None, sh, f, f is not None, "animal", at.date()) for i, at, s, c, b, sh, f in rows], "id long, started_at timestamp_ntz, clip_state string, clip_path string, clip_bytes long, snapshot_path string, thumb_path string, sharp_path string, feedback string, marked boolean, label string, local_date date")
    now = F.lit(day(11, 12)).cast("timestamp_ntz")
    assert {r["id"] for r in retention.expired_events(events, now - F.expr("interval 10 days")).collect()} == {1, 4, 8}
    lengths = spark.createDataFrame([("f", 40), ("a", 99)], "path string, length long")
    over = lambda cap, files=lengths: {r["id"]: r["bytes"] for r in retention.over_cap(events, cap, files).collect()}
    # 80 bytes in all; the marked clip counts and stays.
    assert over(80) == {}
    assert over(79) == {1: 10}
    assert over(30) == {1: 10, 2: 10, 6: 40}
    assert over(30, None) == {1: 10}
    none = spark.createDataFrame([], "segment_id long, camera_id string, seg_start timestamp_ntz, seg_end timestamp_ntz, seg_bytes long")
    report = lambda **o: sorted((r["kind"], r["id"], r["bytes"]) for r in retention.run_once(events, none, now, 69, clips_days=10, files=lengths, **o).collect())
    old = [("expired", 1, 10), ("expired", 4, None), ("expired", 8, None)]
    key = lambda r: (r[0], r[1])
    assert sorted(report(), key=key) == sorted([*old, ("over cap", 2, 10)], key=key)
    assert sorted(report(dry_run=True), key=key) == sorted([*old, ("over cap", 1, 10), ("over cap", 2, 10)], key=key)


def test_a_run_is_tallied_by_outcome(spark):
    kinds = ["named", "named", "not an animal", "still unnamed", "unknown", "no animal"]
    got = {r["tally"]: r["n"] for r in evaluate.outcomes(spark.createDataFrame([(k,) for k in kinds], "outcome string")).collect()}
    assert got == {"named": 2, "relabelled": 2, "unknown": 1, "skipped": 1}


def test_hub_answers_drop_what_comes_again_right_after_itself(spark):
    def file(name, day, minute):
        return {"name": name, "size": 1, "start": {"year": 2024, "mon": 1, "day": day, "hour": 3, "min": minute, "sec": 5}}

    answers = [("h", [file("b", 1, 5), file("a", 1, 1), file("a", 1, 0)]), ("h", [file("a", 1, 7), file("a", 2, 0), file("c", 2, 3), file("a", 2, 4)]), ("k", [file("a", 1, 9)])]
    rows = files.hub_recordings(spark.createDataFrame([(h, json.dumps({"files": f})) for h, f in answers], "hub string, value string"))
    got = sorted((r["hub"], r["start"]["day"], r["start"]["min"], r["name"]) for r in rows.collect())
    assert got == [("h", 1, 0, "a"), ("h", 1, 5, "b"), ("h", 1, 7, "a"), ("h", 2, 3, "c"), ("h", 2, 4, "a"), ("k", 1, 9, "a")]
