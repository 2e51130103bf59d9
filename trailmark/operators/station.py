"""A station's cameras and hubs as small tables, what requests may ask for, and how answers and outcomes are told."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .listing import WINDOWS

#: Seconds after which a battery camera's live view stops.
BATTERY_LIVE = 120
#: Rows of a page if none are asked for, and at most.
DEFAULT_LIMIT, MAX_LIMIT = 50, 500
LABELS = ("person", "vehicle", "animal", "motion")


def request(params: dict[str, str]) -> dict[str, object]:
    """What a list's parameters ask for, checked: limit (1 to 500), newest_first, camera, label, species, window, after, before,
    marked. Empty values count as absent; anything else that isn't allowed is refused."""
    given = {k: v for k, v in params.items() if v != "" or k in ("limit", "order")}
    limit = given.get("limit", str(DEFAULT_LIMIT))
    if not re.fullmatch(r"\+?[0-9]+", limit) or not 1 <= int(limit) <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..={MAX_LIMIT}")
    if given.get("order", "desc") not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    if "label" in given and given["label"] not in LABELS:
        raise ValueError(f"unknown label {given['label']}")
    if "window" in given and given["window"] not in WINDOWS:
        raise ValueError(f"window has to be one of {', '.join(WINDOWS)}")
    ids = {}
    for name, of in (("after", "after_id"), ("before", "before_id")):
        if of in given and not re.fullmatch(r"\+?[0-9]+", given[of]):
            raise ValueError(f"{of} must be a number")
        ids[name] = int(given[of]) if of in given else None
    return {"limit": int(limit), "newest_first": given.get("order", "desc") == "desc", **{k: given.get(k) for k in ("camera", "label", "species", "window")}, **ids, "marked": given.get("wrong") in ("true", "1")}


def day_asked_for(date: str | None, zone: str, now: dt.datetime) -> dt.date:
    """A day written as YYYY-MM-DD, else the station's day at now (UTC)."""
    if not date:
        return now.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).date()
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", date):
        raise ValueError("date must be YYYY-MM-DD")
    try:
        return dt.date.fromisoformat(date)
    except ValueError:
        raise ValueError("date must be YYYY-MM-DD") from None


def enabled(cameras: DataFrame) -> DataFrame:
    return cameras.where(F.coalesce("enabled", F.lit(True)))


def live_url(record: Column, record_url: Column, detect_url: Column) -> Column:
    """The stream that a live view shows: the recorded one, or the detector's of a camera that doesn't record."""
    return F.when(record, record_url).otherwise(detect_url)


def with_hub_credentials(cameras: DataFrame, hubs: DataFrame) -> DataFrame:
    """cameras (hub, kind, and the URLs detect_url, record_url, full_url) of which streams of a hub got its user and password
    (hubs: hub, user, password), where a URL has none."""
    known = hubs.select(F.col("hub").alias("__hub"), "user", "password")
    met = cameras.join(known, (F.col("hub") == F.col("__hub")) & (F.col("kind") == "stream"), "left")
    urls = [F.when(F.col("__hub").isNotNull(), text.with_credentials(F.col(c), F.col("user"), F.col("password"))).otherwise(F.col(c)).alias(c) for c in ("detect_url", "record_url", "full_url")]
    return met.select(*(c for c in cameras.columns if c not in ("detect_url", "record_url", "full_url")), *urls)


def listed_cameras(cameras: DataFrame, battery_live: bool) -> DataFrame:
    """The enabled cameras as a page shows them: whether they record, can be seen live, for how many seconds, and more sharply.
    battery_live: whether battery cameras may be woken for a look."""
    stream = F.col("kind") == "stream"
    woken = (F.col("kind") == "hub_clips") & F.col("hub").isNotNull() & F.lit(battery_live)
    full = text.full_stream_url(F.col("kind"), F.col("detect_url"), F.col("full_url")).isNotNull() | woken
    return enabled(cameras).select("id", "name", "kind", "hub", (F.col("record") & stream).alias("record"), full.alias("full"), (stream | woken).alias("live"), F.when(woken, BATTERY_LIVE).alias("live_seconds"))


def state_name(state: Column) -> Column:
    """A state's name in lower case, without what it holds in parentheses."""
    return F.lower(F.substring_index(state, "(", 1))


def first_value(command: Column, answer: Column) -> Column:
    """The value of the first entry of a hub's answer in JSON; an answer without one, or with an error, stops the query and
    says what the hub said. Use told_error() to keep going."""
    error = told_error(command, answer)
    return F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.get_json_object(answer, "$[0].value"))


def told_error(command: Column, answer: Column) -> Column:
    """What is wrong with a hub's answer, null for nothing."""
    part = lambda path: F.get_json_object(answer, f"$[0].{path}")
    whole = lambda path: F.when(part(path).rlike("^[0-9]+$"), part(path).cast("long"))
    unlock, left = whole("error.auth_warning_info.unlock_time"), whole("error.auth_warning_info.remain_times")
    warning = F.when(unlock > 0, F.concat(F.lit("; the account is locked for "), F.ceil(unlock / 60).cast("string"), F.lit(" more minutes"))).when(left.isNotNull(), F.concat(F.lit("; "), left.cast("string"), F.lit(" attempts left before the Hub locks the account")))
    refused = F.concat(command, F.lit(": "), F.coalesce(part("error.rspCode"), F.lit("0")), F.lit(" "), F.coalesce(part("error.detail"), F.lit("unknown error")), F.coalesce(warning, F.lit("")))
    none = F.get_json_object(answer, "$[0]").isNull()
    return F.when(none, F.concat(command, F.lit(": empty answer"))).when(part("code") == "0", F.lit(None)).otherwise(refused)


def described(outcome: Column, common: Column, scientific: Column, score: Column, label: Column) -> Column:
    """What an outcome of species.reclassified() is in words."""
    named = F.concat(common, F.lit(" ("), scientific, F.lit(") "), F.format_number(score * 100, 0), F.lit(" %"))
    return (
        F.when(outcome == "named", named)
        .when(outcome == "not an animal", F.concat(F.lit("not an animal, a "), label))
        .when(outcome == "still unnamed", "never moved and could not be named: motion")
        .when(outcome == "unknown", "no confident answer")
        .when(outcome == "no animal", "no animal found in the clip")
    )


def minute_counters(frames: DataFrame) -> DataFrame:
    """Counters of each camera by minute from its frames (camera_id, at, moving, looked_at, dropped, ms): what a station logs.
    For a stream with a watermark on at, too."""
    counters = frames.groupBy("camera_id", F.window("at", "1 minute").alias("w")).agg(
        F.count("*").alias("analysed"), F.count_if("moving").alias("motion"), F.count_if("looked_at").alias("looks"), F.count_if("dropped").alias("dropped"), F.avg("ms").alias("mean_ms")
    )
    return counters.select("camera_id", F.col("w.start").alias("minute"), "analysed", "motion", "looks", "dropped", "mean_ms")
