"""Lists, scans and charts over sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing, stats
from ..sources.adapter import CAMERAS, LABELS, NOW, SIGHTINGS, around_day, id_range, sightings, unmarked_sightings
from .registry import query

_COUNTS = ", ".join(f"count(*) filter (where label = '{x}') as {x}" for x in LABELS)
_ZEROS = ", ".join(f"coalesce({x}, 0) as {x}" for x in LABELS)
_URL = "concat('/api/v1/events/', cast(id as varchar), '/{}')".format
_NAME_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
_SHOWN = f"id, camera_id, label, started_at, case when snapshot_path is not null then {_URL('snapshot')} end as snapshot_url, case when coalesce(thumb_path, snapshot_path) is not null then {_URL('thumb')} end as thumb_url, case when clip_state = 'ready' and clip_path is not null then {_URL('clip')} end as clip_url, ended_at is null as active"
_COLUMNS = ("id", "camera_id", "label", "started_at", "snapshot_url", "thumb_url", "clip_url", "active")


@query(f"select {_SHOWN} from sightings where camera_id = 'yard' and started_at >= timestamp '{NOW}' - interval 30 day and id < 9000 order by id desc limit 50", SIGHTINGS)
def sc_list_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.matching(unmarked_sightings(spark, sf_dir, id_range(None, 8999)), camera="yard", since=listing.window_start("30d", NOW))
    return listing.shown(listing.page(found, 50, before=9000)).select(*_COLUMNS)


@query(f"select {_SHOWN} from sightings where label = 'animal' and id > 100 order by id limit 500", SIGHTINGS)
def sc_list_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.matching(unmarked_sightings(spark, sf_dir, id_range(101)), label="animal")
    return listing.shown(listing.page(found, 500, after=100, newest_first=False)).select(*_COLUMNS)


@query("select max(id) as next_after_id, min(id) as next_before_id, count(*) as n from (select id from sightings where marked and id < 5000 order by id desc limit 20)", SIGHTINGS)
def so_page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.cursors(listing.page(listing.matching(sightings(spark, sf_dir, id_range(None, 4999)), marked=True), 20, before=5000))


@query(f"select id, common_name, scientific_name from sightings where {_NAME_FOLD('common_name')} = 'red fox' or {_NAME_FOLD('scientific_name')} = 'red fox'", SIGHTINGS)
def pr_by_species_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.matching(unmarked_sightings(spark, sf_dir), species="RED fox").select("id", "common_name", "scientific_name")


@query("select id, started_at from sightings where started_at >= timestamp '2024-01-10 00:00:00' and started_at < timestamp '2024-01-12 00:00:00'", SIGHTINGS)
def sc_events_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.between(unmarked_sightings(spark, sf_dir), F.expr("timestamp_ntz'2024-01-10 00:00:00'"), F.expr("timestamp_ntz'2024-01-12 00:00:00'")).select("id", "started_at").orderBy("started_at", "id")


@query(f"select id, label from sightings where started_at >= timestamp '{NOW}' - interval 7 day", SIGHTINGS)
def sc_events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.between(unmarked_sightings(spark, sf_dir), listing.window_start("7d", NOW)).select("id", "label")


@query("select id, local_date, local_hour from sightings where local_date = date '2024-01-15'", SIGHTINGS)
def sc_events_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmarked_sightings(spark, sf_dir, around_day("2024-01-15")).where("local_date = date'2024-01-15'").select("id", "local_date", "local_hour")


@query(f"select {_SHOWN} from sightings where id = 77", SIGHTINGS)
def sc_get_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.shown(unmarked_sightings(spark, sf_dir, id_range(77, 77)).where("id = 77")).select(*_COLUMNS)


@query("select camera_id, count(*) as n_events, cast(sum(clip_bytes) as bigint) as bytes, cast(sum(cast(clip_path is not null as bigint) + cast(snapshot_path is not null as bigint) + cast(thumb_path is not null as bigint)) as bigint) as n_files from sightings where camera_id in ('yard', 'gate') and label in ('motion', 'vehicle') and local_date < date '2024-01-20' and ended_at is not null group by camera_id", SIGHTINGS)
def sk_prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listing.prunable(unmarked_sightings(spark, sf_dir), ["yard", "gate"], ["motion", "vehicle"], "2024-01-20")
    files = sum((F.col(c).isNotNull().cast("long") for c in ("clip_path", "snapshot_path", "thumb_path")), F.lit(0))
    return found.groupBy("camera_id").agg(F.count("*").alias("n_events"), F.sum("clip_bytes").alias("bytes"), F.sum(files).alias("n_files"))


@query("select id, camera_id, local_date from sightings where label = 'animal' and clip_path is not null and ended_at is not null and local_date >= date '2024-01-05' and common_name is null and camera_id in ('yard', 'trail')", SIGHTINGS)
def pr_reclassifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.reclassifiable(unmarked_sightings(spark, sf_dir), "2024-01-05", ["yard", "trail"]).select("id", "camera_id", "local_date").orderBy("id")


_DOMAIN = "(values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS)) + ") as d(place, label)"


@query(f"select d.place, d.label, count(s.id) as n from {_DOMAIN} left join (select * from sightings where started_at >= timestamp '{NOW}' - interval 7 day and camera_id = 'gate') s on s.label = d.label group by d.place, d.label", SIGHTINGS)
def ag_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_label(listing.matching(unmarked_sightings(spark, sf_dir), camera="gate", since=listing.window_start("7d", NOW)), zero_filled=True)


@query(
    "select common_name, scientific_name, n, last_seen, id as best_id, score as best_score from (select *, row_number() over (partition by k order by case when clip_state = 'ready' and score > s0 then 0 else 1 end, case when clip_state = 'ready' and score > s0 then -score end, started_at, id) as r from (select id, clip_state, started_at, lower(common_name) as k, coalesce(species_score, top_score) as score, first_value(coalesce(species_score, top_score)) over w as s0, first_value(common_name) over w as common_name, first_value(scientific_name) over w as scientific_name, count(*) over (partition by lower(common_name)) as n, max(started_at) over (partition by lower(common_name)) as last_seen from sightings where label = 'animal' window w as (partition by lower(common_name) order by started_at, id))) where r = 1",
    SIGHTINGS,
)
def ag_by_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_species(unmarked_sightings(spark, sf_dir)).orderBy(F.desc("n"), F.lower("common_name").asc_nulls_first())


@query(f"select cast(h as integer) as local_hour, {_ZEROS} from (select unnest(range(24)) as h) left join (select local_hour, {_COUNTS} from sightings where local_date = date '2024-01-15' group by local_hour) on h = local_hour", SIGHTINGS)
def ag_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hourly(unmarked_sightings(spark, sf_dir, around_day("2024-01-15")).where("local_date = date'2024-01-15'"))


@query(f"select c as camera_id, {_ZEROS} from (values {', '.join(f'({c!r})' for c in CAMERAS)}) as d(c) left join (select camera_id, {_COUNTS} from sightings where local_date = date '2024-01-15' group by camera_id) on c = camera_id", SIGHTINGS)
def ag_cameras_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cameras_today(unmarked_sightings(spark, sf_dir, around_day("2024-01-15")).where("local_date = date'2024-01-15'"), CAMERAS)


_CORRECTED = "corrected as (select *, case when feedback is null then common_name else feedback_species end as animal, case when feedback is null then scientific_name when feedback_species is not null then '' end as animal_scientific from sightings where case when feedback is null then label = 'animal' else feedback = 'animal' end)"
_BY_HOUR = "[" + ", ".join(f"count(*) filter (where local_hour = {h})" for h in range(24)) + "]"


def _tally_sql(where: str) -> str:
    return f"select lower(animal) as key, min_by(animal, (started_at, id)) as animal, count(*) as n, coalesce(min_by(animal_scientific, (started_at, id)) filter (where animal_scientific <> ''), '') as scientific_name, max(started_at) as last_seen, {_BY_HOUR} as by_hour from corrected where animal is not null and {where} group by lower(animal)"


@query(_tally_sql(f"started_at >= timestamp '{NOW}' - interval 30 day"), SIGHTINGS, _CORRECTED)
def ag_animals_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tally(listing.between(sightings(spark, sf_dir), listing.window_start("30d", NOW)))


@query(_tally_sql("local_date = date '2024-01-15'"), SIGHTINGS, _CORRECTED)
def ag_animals_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tally(sightings(spark, sf_dir, around_day("2024-01-15")).where("local_date = date'2024-01-15'"))


@query("select count(*) filter (where animal is null) as unidentified, count(*) as animals from corrected", SIGHTINGS, _CORRECTED)
def ag_unidentified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unidentified(sightings(spark, sf_dir))


@query(
    "select name, n from (select key as name, n from (select *, row_number() over (order by n desc, key) as r from t) where r <= 3) union all select concat('Other (', cast(count(*) as varchar), ')') as name, cast(sum(n) as bigint) as n from (select *, row_number() over (order by n desc, key) as r from t) where r > 3 having count(*) > 0",
    SIGHTINGS,
    _CORRECTED,
    "t as (select lower(animal) as key, count(*) as n from corrected where animal is not null group by lower(animal))",
)
def ag_top_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.tally(sightings(spark, sf_dir)).select(F.col("key").alias("name"), "n")
    return stats.top_and_rest(counts, "name", "n", 3)


@query("select local_hour, label, count(*) as n from sightings group by cube (local_hour, label)", SIGHTINGS)
def ag_hour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hour_totals(unmarked_sightings(spark, sf_dir))


@query("select camera_id, count(*) as n, cast(sum(cast(marked as integer)) as bigint) as n_marked from sightings where clip_state = 'ready' group by camera_id", SIGHTINGS)
def ag_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).where("clip_state = 'ready'").groupBy("camera_id").agg(F.count("*").alias("n"), F.sum(F.col("marked").cast("long")).alias("n_marked"))


_KEY = "case when label = 'animal' then lower(common_name) end"


@query(f"select case when grouping(label) = 0 then 'label' when grouping(local_hour) = 0 then 'hour' when grouping(camera_id) = 0 then 'camera' else 'species' end as chart, coalesce(label, cast(local_hour as varchar), camera_id, key) as name, count(*) as n from (select label, local_hour, camera_id, {_KEY} as key, label = 'animal' as is_animal from sightings where started_at >= timestamp '{NOW}' - interval 7 day) group by grouping sets ((label), (local_hour), (camera_id), (key, is_animal)) having grouping(is_animal) = 1 or is_animal", SIGHTINGS)
def ag_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overview(listing.between(unmarked_sightings(spark, sf_dir), listing.window_start("7d", NOW)))
