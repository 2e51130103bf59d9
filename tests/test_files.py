"""Label, geofence, segment and corpus files, and their sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from trailmark.sources import files
from trailmark.sources.adapter import segments, sightings


def test_label_files(spark):
    lines = ["u1;mammalia;carnivora;canidae;vulpes;vulpes;red fox", "too;few;fields", "u2;;;;;;blank", "u3;mammalia;carnivora;canidae;vulpes;vulpes;fox again"]
    read = files.labels(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert read.count() == 3
    kept = {r["taxon"]: r["uuid"] for r in files.taxonomy(read, "uuid").collect()}
    assert kept == {"mammalia;carnivora;canidae;vulpes;vulpes": "u3", ";;;;": "u2"}


def test_geofence_files(spark):
    text = json.dumps({"a;b": {"allow": {"US": ["NY"]}}, "c": {"block": {"CA": []}}})
    rows = {r["taxon"]: (r["allow"], r["block"]) for r in files.geofence(spark.createDataFrame([(text,)], "value string")).collect()}
    assert rows == {"a;b": ({"US": ["NY"]}, {}), "c": ({}, {"CA": []})}


def test_segment_indexes_and_bytes(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"codec": "avc1", "width": 4, "height": 2, "config": "00", "samples": [{"offset": 0, "size": 3, "key": True, "wall_us": 5, "ticks": 9}, {"offset": 3, "size": 2, "key": False, "wall_us": 6, "ticks": 9}]}, indent=1))
    rows = files.segment_samples(spark, str(tmp_path / "one.json")).orderBy("place").collect()
    assert [(r["offset"], r["size"], r["key"]) for r in rows] == [(0, 3, True), (3, 2, False)]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.bin").write_bytes(b"abcde")
    held = spark.read.format("binaryFile").load(str(tmp_path / "v"))
    cut = files.sample_bytes(held, held.select("path").withColumn("offset", F.lit(3)).withColumn("size", F.lit(2)))
    assert bytes(cut.first()["bytes"]) == b"de"
    assert tuple(files.folder_size(spark, str(tmp_path / "v")).first()) == (1, 5)


def test_hub_answers(spark):
    start = {"year": 2024, "mon": 1, "day": 2, "hour": 3, "min": 4, "sec": 5}
    text = json.dumps({"files": [{"name": "a", "size": 7, "start": start}, {"name": "b", "size": "8", "start": start}, {"name": "b", "size": "8", "start": start}, {"name": "c", "size": "?", "start": start}]})
    rows = {r["name"]: r["size"] for r in files.hub_recordings(spark.createDataFrame([(text,)], "value string")).collect()}
    assert rows == {"a": 7, "b": 8, "c": None}


def test_segments_are_written_by_camera_and_day(spark, sf_dir, tmp_path):
    rows = segments(spark, sf_dir)
    files.write_segments(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == rows.count()
    plan = back.where("camera_id = 'yard' and day = 20240115")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(camera_id" in plan


def test_corpus_round_trip(spark, sf_dir, tmp_path):
    cases = sightings(spark, sf_dir).where("marked").select("id", "camera_id", "label")
    files.write_corpus(cases, str(tmp_path / "c"))
    back = files.read_corpus(spark, str(tmp_path / "c"), "id long, camera_id string, label string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cases.collect()))


def plan_of(name, spark, sf_dir):
    return entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_filters_of_registered_queries_reach_the_scan(spark, sf_dir):
    one = plan_of("sc_get_event", spark, sf_dir)
    assert "GreaterThanOrEqual(event_id,76), LessThanOrEqual(event_id,76)" in one
    for name in ("sc_events_on_day", "ag_hourly", "ag_cameras_today", "ag_animals_daily"):
        plan = plan_of(name, spark, sf_dir)
        assert "GreaterThanOrEqual(ts,2024-01-14" in plan and "LessThan(ts,2024-01-17" in plan
    assert "LessThanOrEqual(event_id,8998)" in plan_of("sc_list_newest", spark, sf_dir)


def test_queries_without_marks_read_no_marks(spark, sf_dir):
    for name in ("sc_get_event", "sc_list_newest", "ag_by_label", "ag_by_species", "ag_hourly", "ag_overview"):
        assert "doc_id" not in plan_of(name, spark, sf_dir)
