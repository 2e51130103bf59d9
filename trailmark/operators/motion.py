"""Motion events of cameras, recordings in which nothing was found, and what hubs, cameras and streams say of themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .species import let

EVENT = "camera_id string, n long, started_ms long, ended_ms long, picture_ms long"


class Watch:
    """The motion of one camera: the run and the event that are open, and what one frame does to them."""

    def __init__(self, start_after: int = 3_000, gap: int = 1_000, quiet: int = 5_000, cooldown: int = 120_000, longest: int | None = None, held: tuple | None = None) -> None:
        self.limits = (start_after, gap, quiet, cooldown, longest)
        #: When the run began, its last motion, its most motion and when that was; start, end and picture of the open event;
        #: the end of the cooldown; events so far.
        self.since, self.seen, self.area, self.best, self.start, self.last, self.picture, self.until, self.n = held or (*(None,) * 8, 0)

    @property
    def held(self) -> tuple:
        return (self.since, self.seen, self.area, self.best, self.start, self.last, self.picture, self.until, self.n)

    def finish(self) -> list[tuple]:
        """The open event ends at its last motion."""
        out = [] if self.start is None else [(self.n, self.start, self.last, self.picture)]
        if out:
            self.since = self.area = self.best = None
        self.start = self.last = self.picture = None
        return out

    def frame(self, at: int, moving: bool, area: float, objects: bool) -> list[tuple]:
        start_after, gap, quiet, cooldown, longest = self.limits
        if objects or not moving:
            if objects:
                self.since = self.area = self.best = None
            if self.start is not None and (objects or at - self.last > quiet):
                self.until = at + cooldown
                return self.finish()
            return []
        if self.seen is not None and at - self.seen > gap:
            self.since = self.area = self.best = None
        self.seen, self.since = at, at if self.since is None else self.since
        if self.area is None or area > self.area:
            self.area, self.best = area, at
        if self.start is not None:
            self.last = at
            if longest is not None and at - self.start >= longest:
                out = [(self.n, self.start, self.last, self.picture)]
                self.n, self.start, self.picture = self.n + 1, at, at
                return out
        elif at - self.since >= start_after and (self.until is None or at >= self.until):
            self.n, self.start, self.last, self.picture = self.n + 1, self.since, at, self.best
        return []


def events_table(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])


def sound_frames(frames: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return frames.select("camera_id", "id", "at_ms", flag("moving"), F.coalesce("area", F.lit(0.0)).alias("area"), flag("objects")).where("camera_id is not null and at_ms is not null")


def motion_events(frames: DataFrame, **limits: int | None) -> DataFrame:
    """Events of a camera's frames (camera_id, id, at_ms, moving, area, objects), times in milliseconds. limits: start_after
    (3,000), gap (1,000), quiet (5,000), cooldown (120,000) and longest (none).

    A run of motion has no pause over gap. It opens an event once it has lasted start_after and the cooldown since the last
    event's end is over; the event begins where the run did, and its picture is the frame with most motion until then. An
    event ends at its last motion, when a frame without motion comes over quiet later or something is recognised, which
    explains the motion. From longest on, if given, it ends and another begins at once. What is open after the last frame ends at its
    last motion. Only a camera's open event is held; null for moving or objects counts as false, for area as 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, watch = None, Watch(**limits)
        for part in batches:
            out = []
            for k, *frame in zip(part["camera_id"], part["at_ms"], part["moving"], part["area"], part["objects"], strict=True):
                if k != camera:
                    out += [(camera, *e) for e in watch.finish()]
                    camera, watch = k, Watch(**limits)
                out += [(k, *e) for e in watch.frame(*frame)]
            yield events_table(out)
        yield events_table([(camera, *e) for e in watch.finish()])

    return sound_frames(frames).repartition("camera_id").sortWithinPartitions("camera_id", "at_ms", "id").mapInPandas(run, EVENT)


def silent_recordings(recordings: DataFrame, events: DataFrame) -> DataFrame:
    """A motion event for each recording (camera_id, clip_path, rec_start, rec_end, clip_bytes) in which nothing was found:
    all of its time, with the clip it already has."""
    empty = recordings.join(events.select("clip_path"), "clip_path", "left_anti")
    none = F.lit(0.0)
    return empty.select("camera_id", F.lit("motion").alias("label"), F.lit("pir").alias("raw_class"), F.col("rec_start").alias("started_at"), F.col("rec_end").alias("ended_at"), none.alias("top_score"), none.alias("median_score"), F.lit("ready").alias("clip_state"), "clip_path", "clip_bytes")


def best_crops(crops: DataFrame, key: str, most: int, label: str = "animal") -> DataFrame:
    """Of each clip the best crops (crop, label, quality, moved) of what has that label, and whether any of it moved.

    Clips without such a crop have no row. The rows of one clip are few; ties go to the smaller crop."""
    mine = crops.where(F.col("label") == label)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("quality"), "crop"))
    best = mine.withColumn("place", place).withColumn("moved", F.bool_or("moved").over(Window.partitionBy(key)))
    return best.where(F.col("place") <= most).select(key, "place", "crop", "quality", "moved")


def sharpest(views: DataFrame, key: str) -> DataFrame:
    """The view of best quality of each event, of equals the last."""
    return views.groupBy(key).agg(F.max_by("view", F.struct("quality", "view")).alias("view"), F.max("quality").alias("quality"))


def hub_channels(status: Column) -> Column:
    """A hub's answer about its channels, as JSON, as an array of channel, name, online, sleeping; items without a channel are left out."""
    said = F.from_json(status, "status array<struct<channel int, name string, online int, sleep int>>")["status"]
    known = F.filter(F.coalesce(said, F.array().cast("array<struct<channel int, name string, online int, sleep int>>")), lambda c: c["channel"].isNotNull())
    is_one = lambda c: F.coalesce(c == 1, F.lit(False))
    return F.transform(known, lambda c: F.struct(c["channel"].alias("channel"), F.coalesce(c["name"], F.lit("")).alias("name"), is_one(c["online"]).alias("online"), is_one(c["sleep"]).alias("sleeping")))


def _byte(config: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(config, at + 1, 1)), 16, 10).cast("int")


def codec_string(codec: Column, config: Column) -> Column:
    """The name by which browsers know a stream (RFC 6381), from its decoder's configuration; null where that is too short."""
    avc = F.when(F.octet_length(config) >= 4, F.concat(F.lit("avc1."), F.lower(F.hex(F.substring(config, 2, 3)))))
    flags = F.lpad(F.conv(F.hex(F.substring(config, 3, 4)), 16, 2), 32, "0")
    constraints = F.regexp_replace(F.hex(F.substring(config, 7, 6)), "(?:00)+$", "")
    hvc = F.concat(
        F.lit("hvc1."),
        F.element_at(F.array(*map(F.lit, ("", "A", "B", "C"))), F.shiftright(_byte(config, 1), 6) + 1),
        _byte(config, 1).bitwiseAND(0x1F).cast("string"),
        F.lit("."),
        F.conv(F.reverse(flags), 2, 16),
        F.when(_byte(config, 1).bitwiseAND(0x20) != 0, ".H").otherwise(".L"),
        _byte(config, 12).cast("string"),
        F.regexp_replace(F.regexp_replace(constraints, "(..)", ".$1"), r"\.0(.)", ".$1"),
    )
    return F.when(codec == "h264", avc).when((codec == "h265") & (F.octet_length(config) >= 13), hvc)


_PROFILE = "_token string, Name string, VideoSourceConfiguration struct<SourceToken string>, VideoEncoderConfiguration struct<_token string, Encoding string, Resolution struct<Width string, Height string>, RateControl struct<FrameRateLimit string, BitrateLimit string>>"
_SIZES = "struct<ResolutionsAvailable array<struct<Width string, Height string>>>"
#: Codecs of which a camera tells the sizes that it can encode.
SIZED = ("JPEG", "MPEG4", "H264")


def _xml(said: Column, schema: str) -> Column:
    return F.from_xml(said, f"Body struct<{schema}>", {"ignoreNamespace": "true"})["Body"]


def camera_profiles(said: Column) -> Column:
    """A camera's answer about its media profiles (SOAP, whatever its prefixes) as an array of token, name, source, encoding,
    width, height, fps, bitrate_kbps, encoder. Missing texts are empty, missing or odd sizes 0, rates null."""
    text = lambda c: F.coalesce(c, F.lit(""))
    whole = lambda c: c.try_cast("int")

    def one(p: Column) -> Column:
        encoder = p["VideoEncoderConfiguration"]
        size, rate = encoder["Resolution"], encoder["RateControl"]
        return F.struct(
            text(p["_token"]).alias("token"),
            text(p["Name"]).alias("name"),
            text(p["VideoSourceConfiguration"]["SourceToken"]).alias("source"),
            text(encoder["Encoding"]).alias("encoding"),
            F.coalesce(whole(size["Width"]), F.lit(0)).alias("width"),
            F.coalesce(whole(size["Height"]), F.lit(0)).alias("height"),
            whole(rate["FrameRateLimit"]).alias("fps"),
            whole(rate["BitrateLimit"]).alias("bitrate_kbps"),
            text(encoder["_token"]).alias("encoder"),
        )

    return F.transform(_xml(said, f"GetProfilesResponse struct<Profiles array<struct<{_PROFILE}>>>")["GetProfilesResponse"]["Profiles"], one)


def allowed_sizes(said: Column) -> Column:
    """A camera's answer about an encoder as an array of codec, width, height; sizes that aren't whole numbers are left out."""
    each = ", ".join(f"{c} {_SIZES}" for c in SIZED)
    options = _xml(said, f"GetVideoEncoderConfigurationOptionsResponse struct<Options struct<{each}>>")["GetVideoEncoderConfigurationOptionsResponse"]["Options"]
    none = F.array().cast("array<struct<codec string, width int, height int>>")
    sizes = lambda o, c: F.transform(o[c]["ResolutionsAvailable"], lambda r: F.struct(F.lit(c).alias("codec"), r["Width"].try_cast("int").alias("width"), r["Height"].try_cast("int").alias("height")))
    # The answer is read once for all codecs.
    return let(options, lambda o: F.filter(F.concat(*(F.coalesce(sizes(o, c), none) for c in SIZED)), lambda r: r["width"].isNotNull() & r["height"].isNotNull()))
