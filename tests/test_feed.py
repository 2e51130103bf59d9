"""A change feed whose writer is broken off, restarted and compacted, against one that isn't."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trailmark.operators import jobs
from trailmark.sources.ledger import Ledger
from trailmark.streaming.feed import Feed, versions

SCHEMA = "id long, seq long, kind string, value double"


class Breaking(Ledger):
    """Dies after the changes of one batch are written and before the ledger knows of them."""

    dies_at = None

    def commit(self, batch: int) -> None:
        if batch == self.dies_at:
            self.dies_at = None
            raise RuntimeError("killed")
        super().commit(batch)


@pytest.fixture
def batches(spark, tmp_path):
    """Files of changes, each a micro-batch, and the plain state after each."""
    rng, state, seq, out, log = random.Random(8), {}, 0, [], []
    for b in range(5):
        rows = []
        for _ in range(60):
            seq += 1
            kind = rng.choice(["started", "updated", "updated", "ended", "removed"])
            rows.append((rng.randint(1, 40), seq, kind, float(seq)))
        rng.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{b}"))
        for r in sorted(rows, key=lambda r: r[1]):
            state[r[0]] = r
        log.append(rows)
        out.append({r for r in state.values() if r[2] != "removed"})
    return out, log


def source(spark, tmp_path, upto):
    (tmp_path / "all").mkdir(exist_ok=True)
    for b in range(upto):
        for f in (tmp_path / f"in/{b}").glob("part-*"):
            if not (at := tmp_path / "all" / f"{b}-{f.name}").exists():
                at.write_bytes(f.read_bytes())
                os.utime(at, (1_700_000_000 + 10 * b,) * 2)  # files are taken in order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))


def plain(df):
    return {(r["id"], r["seq"], r["kind"], r["value"]) for r in df.collect()}


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, batches):
    states, log = batches
    schema = spark.createDataFrame([], SCHEMA).schema
    whole = Feed(spark, f"file://{tmp_path}/whole", schema)
    whole.write(source(spark, tmp_path, 5), str(tmp_path / "whole-state"), availableNow=True).awaitTermination()
    broken = Feed(spark, f"file://{tmp_path}/broken", schema)
    broken.ledger = Breaking(spark, broken.folder)
    broken.ledger.dies_at = 2
    with pytest.raises(StreamingQueryException):
        broken.write(source(spark, tmp_path, 5), str(tmp_path / "broken-state"), availableNow=True).awaitTermination()
    # The third batch's changes lie there, but no reader sees them.
    assert (tmp_path / "broken/changes/batch=2/_SUCCESS").exists() and broken.position() == 1
    assert plain(broken.table()) == states[1] and broken.changes().count() == 120
    again = Feed(spark, broken.folder, schema)
    again.write(source(spark, tmp_path, 5), str(tmp_path / "broken-state"), availableNow=True).awaitTermination()
    assert plain(again.table()) == plain(whole.table()) == states[4]
    assert sorted(map(tuple, again.changes().collect())) == sorted(map(tuple, whole.changes().collect()))
    assert again.changes().count() == sum(map(len, log))


def test_replay_then_follow_has_all_and_nothing_twice(spark, tmp_path, batches):
    states, log = batches
    made = Feed(spark, f"file://{tmp_path}/feed", spark.createDataFrame([], SCHEMA).schema)
    assert made.position() == -1 and made.table().isEmpty() and made.replay(0)[1].isEmpty() and made.compact() == -1
    run = lambda n: made.write(source(spark, tmp_path, n), str(tmp_path / "state"), availableNow=True).awaitTermination()
    run(2)
    position, missed = made.replay(10)
    run(4)
    rows = missed.collect()
    want = sorted(r for r in states[position] if r[0] > 10)
    assert [r["id"] for r in rows] == [r[0] for r in want]
    assert [r["kind"] for r in rows] == ["ended" if r[2] == "ended" else "started" for r in want]
    assert [r["id"] for r in made.replay(10, 3)[1].collect()] == sorted(r[0] for r in states[made.position()] if r[0] > 10)[:3]
    followed = made.changes(position)
    assert followed.count() == 60 * (made.position() - position) == 120
    # What was replayed and what follows adds up to the table.
    state = {r[0]: r for r in states[position]}
    for r in sorted(map(tuple, followed.select("id", "seq", "kind", "value").collect()), key=lambda r: r[1]):
        state[r[0]] = r
    assert {r for r in state.values() if r[2] != "removed"} == plain(made.table())
    # A snapshot changes nothing, whatever comes after it; a batch that is put twice counts once.
    assert made.compact() == 3
    run(5)
    assert plain(made.table()) == states[4] and plain(made.table(1)) == states[1] and plain(made.table(3)) == states[3]
    made.put(spark.createDataFrame([(1, 10_000, "started", 1.0)], SCHEMA), 4)
    assert plain(made.table()) == states[4]
    last = {r["id"]: r["version"] for r in versions(made.changes()).orderBy("version").collect()}
    assert sum(last.values()) == sum(map(len, log))


def test_imports_run_twice_or_broken_off_are_one(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    files = [("h", f"f{i}", "yard", at(i), at(i + 1), f"clips/{i}.mp4", 1_000 + i) for i in range(6)]
    files = spark.createDataFrame(files, "hub string, file string, camera_id string, file_start timestamp_ntz, file_end timestamp_ntz, clip_path string, bytes long")
    tracks = [("h", "f0", 1, "animal", 0, 1, 0.8, 0.7, True, [(0.5, 11)]), ("h", "f0", 2, "animal", 0, 1, 0.6, 0.5, False, [(0.9, 21)]), ("h", "f0", 3, "motion", 0, 1, 0.0, 0.0, False, []), ("h", "f2", 4, "motion", 2, 3, 0.0, 0.0, False, []), ("h", "f5", 5, "person", 5, 6, 0.9, 0.9, True, [])]
    tracks = spark.createDataFrame([(h, f, i, lab, at(s), at(e), *r) for h, f, i, lab, s, e, *r in tracks], "hub string, file string, id long, label string, started_at timestamp_ntz, ended_at timestamp_ntz, top_score double, median_score double, moved boolean, crops array<struct<quality:double,crop:long>>")
    now = lambda m: F.lit(at(m)).cast("timestamp_ntz")

    def told(folder):
        made = jobs.Imports(Ledger(spark, folder))
        return [sorted(map(str, t.collect())) for t in (made.events(), made.outcomes())]

    whole = f"file://{tmp_path}/whole"
    for keep_motion, minute in ((True, 4), (True, 4), (False, 9)):
        jobs.Imports(Ledger(spark, whole)).run(files, tracks, now(minute), keep_motion=keep_motion)
    events = {(r["file"], r["label"]): r for r in jobs.Imports(Ledger(spark, whole)).events().collect()}
    assert set(events) == {("f0", "animal"), ("f1", "motion"), ("f2", "motion"), ("f5", "person")}
    assert events["f0", "animal"]["top_score"] == 0.8 and sorted(r["id"] for r in events.values()) == [1, 2, 3, 4]
    outcomes = {r["file"]: r["event_id"] for r in jobs.Imports(Ledger(spark, whole)).outcomes().collect()}
    assert outcomes == {"f0": 0, "f1": events["f1", "motion"]["id"], "f2": 0, "f3": -1, "f4": -1, "f5": 0}
    # The same, but that both runs that do anything break off once before they end.
    broken = f"file://{tmp_path}/broken"
    for keep_motion, minute in ((True, 4), (False, 9)):
        ledger = Breaking(spark, broken)
        ledger.dies_at = ledger.position() + 1
        with pytest.raises(RuntimeError):
            jobs.Imports(ledger).run(files, tracks, now(minute), keep_motion=keep_motion)
        before = told(broken)
        jobs.Imports(Ledger(spark, broken)).run(files, tracks, now(minute), keep_motion=keep_motion)
        assert told(broken) != before
    assert told(broken) == told(whole)


def test_an_import_reads_its_tracks_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("h", f"f{i}", "yard", start, start, "c", 1) for i in range(6)], "hub string, file string, camera_id string, file_start timestamp_ntz, file_end timestamp_ntz, clip_path string, bytes long")
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        read.add(1)
        return i

    none = F.array().cast("array<struct<quality:double,crop:long>>")
    tracks = spark.range(40).select(F.lit("h").alias("hub"), F.concat(F.lit("f"), F.col("id") % 4).alias("file"), seen("id").alias("id"), F.lit("animal").alias("label"), F.lit(start).cast("timestamp_ntz").alias("started_at"), F.lit(start).cast("timestamp_ntz").alias("ended_at"), (F.col("id") / 50).alias("top_score"), F.lit(0.5).alias("median_score"), F.lit(True).alias("moved"), none.alias("crops"))
    made = jobs.Imports(Ledger(spark, f"file://{tmp_path}/once"))
    made.run(files, tracks, F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz"))
    assert {(r["file"], r["label"], r["top_score"]) for r in made.events().collect()} == {*((f"f{i}", "animal", (36 + i) / 50) for i in range(4)), ("f4", "motion", 0.0), ("f5", "motion", 0.0)}
    assert read.value <= 40


def test_reclassified_once_whatever_breaks_off(spark, tmp_path):
    rows = [(i, "animal", name, "c", dt.date(2024, 1, 1 + i)) for i, name in enumerate([None, None, None, None, "fox", None])] + [(9, "person", None, "c", dt.date(2024, 1, 3))]
    events = spark.createDataFrame([(*r, f"clips/{r[0]}", dt.datetime(2024, 1, 1)) for r in rows], "id long, label string, common_name string, camera_id string, local_date date, clip_path string, ended_at timestamp_ntz")
    answers = spark.createDataFrame([(1, "Deer", None, True, True), (2, None, "person", True, True), (3, None, None, False, True), (4, "wolf", None, True, True), (5, None, None, True, True)], "id long, name string, said string, moved boolean, has_crops boolean")
    made = jobs.Reclassified(Breaking(spark, f"file://{tmp_path}/r"))
    made.ledger.dies_at = 0
    with pytest.raises(RuntimeError):
        made.run(events, answers, "2024-01-02")
    assert sorted(map(tuple, made.events(events).select("id", "label", "common_name").collect())) == sorted((i, lab, n) for i, lab, n, *_ in rows)
    assert {r["tally"]: r["n"] for r in made.run(events, answers, "2024-01-02").collect()} == {"named": 1, "relabelled": 2, "unknown": 1}
    now = {r["id"]: (r["label"], r["common_name"]) for r in made.events(events).collect()}
    assert now == {0: ("animal", None), 1: ("animal", "Deer"), 2: ("person", None), 3: ("motion", None), 4: ("animal", "fox"), 5: ("animal", None), 9: ("person", None)}
    # What is named or no animal any more isn't looked at again.
    assert {r["tally"]: r["n"] for r in made.run(events, answers, "2024-01-02").collect()} == {"unknown": 1}
    assert {r["id"]: (r["label"], r["common_name"]) for r in made.events(events).collect()} == now
