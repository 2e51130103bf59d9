"""Times: stored in UTC without a zone, seen in a station's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def local_midnight(day: Column, zone: str) -> Column:
    """The UTC time at which a local day begins, the earlier one if its midnight comes twice; where clocks are put forward at
    midnight, so that it doesn't come at all, midnight UTC."""
    given = day.cast("timestamp_ntz")
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), given)
    return F.when(local(at, zone) == given, at).otherwise(given)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def duration_seconds(start: Column, end: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", start, F.coalesce(end, now))


def day_parts(start: Column, end: Column, zone: str) -> Column:
    """(from_at, to_at) for each local day that a range touches; the range's end counts to the whole second."""
    days = F.sequence(F.to_date(local(start, zone)), F.to_date(local(end, zone)))
    return F.transform(days, lambda d: F.struct(F.greatest(start, local_midnight(d, zone)).alias("from_at"), F.least(end, local_midnight(F.date_add(d, 1), zone) - F.expr("interval 1 second")).alias("to_at")))


def fields(ts: Column) -> Column:
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("mon"), F.dayofmonth(ts).alias("day"), F.hour(ts).alias("hour"), F.minute(ts).alias("min"), F.second(ts).cast("int").alias("sec"))


def from_fields(parts: Column, zone: str) -> Column:
    """The UTC time of local calendar fields, null where they are no time."""
    made = F.try_make_timestamp_ntz(parts["year"], parts["mon"], parts["day"], parts["hour"], parts["min"], parts["sec"])
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), made)


def camera_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A camera's clock, which may count years from 1900 and months from 0 as C does."""
    c_style = year < 1900
    return F.try_make_timestamp_ntz(F.when(c_style, year + 1900).otherwise(year), F.when(c_style, month + 1).otherwise(month), day, hour, minute, second)


def sample_end(wall_micros: Column, ticks: Column) -> Column:
    """The end of a video sample, from its start in microseconds and its length in ticks of a 90 kHz clock."""
    return wall_micros + F.floor(ticks * 100 / 9)
