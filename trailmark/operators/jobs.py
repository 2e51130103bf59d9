"""Imports of hub recordings and classifying again, as jobs that are done once: what they write comes to be all at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from ..sources.scratch import stored
from . import evaluate, joins, listing, ordered, retention, species

EVENTS = "id long, hub string, file string, camera_id string, label string, started_at timestamp_ntz, ended_at timestamp_ntz, top_score double, median_score double, moved boolean, crops array<long>, clip_path string, clip_bytes long"
OUTCOMES = "hub string, file string, event_id long"
#: What became of a file: its events are in the table, or nothing of it was kept.
ANALYSED, NOTHING = 0, -1


@dataclass
class Imports:
    """The events of imported recordings, and what became of each file."""

    ledger: Ledger

    def events(self) -> DataFrame:
        return self.ledger.table("events", EVENTS).drop("batch")

    def outcomes(self) -> DataFrame:
        return self.ledger.table("outcomes", OUTCOMES).drop("batch")

    def run(self, files: DataFrame, tracks: DataFrame, now: Column, settle: str = "10 seconds", keep_motion: bool = True, most_crops: int = 3) -> None:
        """Imports the files (hub, file, camera_id, file_start, file_end, clip_path, bytes) that have ended for long enough and
        that no run has imported. tracks: what the analysis found in them (hub, file and what ordered.merged_recordings
        takes). A file without any is a motion event, or nothing is kept of it (keep_motion). Without files to import
        nothing is written. What several steps of a run need is stored once."""
        todo = stored(joins.not_imported(files, self.outcomes().select("hub", "file"), now, settle), "todo")
        if todo.isEmpty():
            return
        name = F.struct("hub", "file")
        read = tracks.select("hub", "file", "id", "label", "started_at", "ended_at", "top_score", "median_score", "moved", "crops")
        found = read.join(todo.select("hub", "file"), ["hub", "file"], "left_semi").withColumn("recording", name).drop("hub", "file")
        merged = ordered.merged_recordings(stored(found, "found"), most_crops).select(F.col("recording.hub").alias("hub"), F.col("recording.file").alias("file"), "label", "started_at", "ended_at", "top_score", "median_score", "moved", "crops")
        merged = stored(merged, "merged")
        silent = todo.join(merged.select("hub", "file").distinct(), ["hub", "file"], "left_anti")
        none = F.array().cast("array<long>")
        motion = silent.where(F.lit(keep_motion)).select("hub", "file", F.lit("motion").alias("label"), F.col("file_start").alias("started_at"), F.col("file_end").alias("ended_at"), F.lit(0.0).alias("top_score"), F.lit(0.0).alias("median_score"), F.lit(False).alias("moved"), none.alias("crops"))
        new = merged.unionByName(motion).join(todo.select("hub", "file", "camera_id", "clip_path", F.col("bytes").alias("clip_bytes")), ["hub", "file"])
        events = stored(retention.with_ids(new, self.events(), "started_at", "hub", "file", "label"), "events")
        own = events.join(silent.select("hub", "file"), ["hub", "file"], "left_semi").select("hub", "file", F.col("id").alias("event_id"))
        kept = events.select("hub", "file").distinct().withColumn("kept", F.lit(True))
        outcomes = todo.select("hub", "file").join(own, ["hub", "file"], "left").join(kept, ["hub", "file"], "left")
        outcome = F.coalesce("event_id", F.when(F.col("kept"), F.lit(ANALYSED)).otherwise(NOTHING)).cast("long")
        columns = [c.split()[0] for c in EVENTS.split(", ")]
        self.ledger.put(self.ledger.position() + 1, {"events": events.select(*columns), "outcomes": outcomes.select("hub", "file", outcome.alias("event_id"))})


PATCHES = "id long, outcome string, label string, species string"


@dataclass
class Reclassified:
    """What classifying stored animals again has changed, run after run."""

    ledger: Ledger

    def events(self, stored: DataFrame) -> DataFrame:
        """stored with all patches: for each field the last run that sets it wins."""
        patches = self.ledger.table("patches", PATCHES)
        entry = lambda c: F.struct(F.col(c).isNotNull().alias("is_set"), F.col(c).alias("value"))
        made = patches.select("id", F.col("batch").alias("seq"), entry("label").alias("label"), entry("species").alias("common_name"))
        return retention.patched(stored, made, ["label", "common_name"])

    def run(self, stored: DataFrame, answers: DataFrame, since: str, cameras: list[str] | None = None, named_too: bool = False, still_as_motion: bool = True) -> DataFrame:
        """Judges the events that listing.reclassifiable() names, as they are now, by answers (id, name, said, moved, has_crops),
        and stores what changes; returns the run's tally."""
        todo = listing.reclassifiable(self.events(stored), since, cameras, named_too).select("id").join(answers, "id")
        outcome, label = species.reclassified(F.col("name"), F.col("said"), F.col("moved"), F.col("has_crops"), still_as_motion)
        judged = todo.select("id", "name", outcome.alias("outcome"), label.alias("label"))
        change = species.patch(F.col("outcome"), F.col("name"), F.col("label"))
        rows = judged.select("id", "outcome", change["label"].alias("label"), change["species"].alias("species"))
        batch = self.ledger.position() + 1
        self.ledger.put(batch, {"patches": rows})
        return evaluate.outcomes(self.ledger.table("patches", PATCHES, batch - 1, batch))
