"""Evaluation over sightings: findings are the events of the same clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources.adapter import SIGHTINGS, sightings
from .registry import query
from .species import RECLASSIFIED, RECLASSIFIED_KEPT, reclassified_animals, sp_reclassified

_FINDINGS = "findings as (select clip as id, label, common_name as name, place from (select id - id % 4 as clip, label, common_name, id % 4 as place from sightings where top_score >= 0.5))"
_LABEL = "case when coalesce(feedback, label) not in ('nothing', 'motion') then coalesce(feedback, label) end"
_WANT = f"""want as (
    select id, camera_id, marked, want_label, case when want_label = 'animal' then case when feedback is null then common_name else feedback_species end end as want_species,
        case when want_label is not null and feedback <> label and label <> 'motion' then label end as not_label,
        case when want_label = 'animal' and feedback = label and feedback_species is null then common_name end as not_species
    from (select *, {_LABEL} as want_label from sightings))"""
_SAME = "coalesce(f.name <> '' and (contains(lower(trim(f.name)), lower(trim({0}))) or contains(lower(trim({0})), lower(trim(f.name)))), false)".format
_RUN = f"""run as (
    select w.id, w.camera_id, w.marked, w.want_label, w.want_species, w.not_label, w.not_species,
        case when want_label is null then count(*) filter (where f.label <> 'motion') = 0
            else count(*) filter (where f.label = want_label) > 0 and count(*) filter (where f.label = not_label) = 0
                and (want_species is null or count(*) filter (where f.label = want_label and {_SAME('want_species')}) > 0)
                and (not_species is null or count(*) filter (where f.label = want_label and {_SAME('not_species')}) = 0) end as passed
    from want w left join findings f on f.id = w.id group by w.id, w.camera_id, w.marked, w.want_label, w.want_species, w.not_label, w.not_species)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sightings(spark, sf_dir).where("top_score >= 0.5")
    return s.select((F.col("id") - F.col("id") % 4).alias("id"), "label", F.col("common_name").alias("name"), (F.col("id") % 4).alias("place"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judged(sightings(spark, sf_dir), _findings(spark, sf_dir))


@query("select id, want_label, want_species, not_label, not_species, passed from run", SIGHTINGS, _FINDINGS, _WANT, _RUN)
def ev_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).select("id", "want_label", "want_species", "not_label", "not_species", "passed")


@query("select camera_id, count(*) filter (where marked and passed) as fixed, count(*) filter (where marked and not passed) as wrong, count(*) filter (where not marked and passed) as same, count(*) filter (where not marked and not passed) as changed from run group by rollup (camera_id)", SIGHTINGS, _FINDINGS, _WANT, _RUN)
def ev_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scorecard(_run(spark, sf_dir))


@query("select case when camera_id = 'gate' then 'new' when passed and id % 3 = 0 then 'better' when not passed and id % 3 <> 0 then 'worse' else 'alike' end as change, count(*) as n from run group by 1", SIGHTINGS, _FINDINGS, _WANT, _RUN)
def ev_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a baseline that passed what isn't divisible by 3 and knew nothing of one camera."""
    run = _run(spark, sf_dir)
    return evaluate.compared(run, run.where("camera_id <> 'gate'").select("id", (F.col("id") % 3 != 0).alias("passed")))


@query("select id, string_agg(case when n > 1 then concat(text, ' ×', cast(n as varchar)) else text end, ', ' order by first, text) as summary from (select id, coalesce(name, label) as text, count(*) as n, min(place) as first from findings group by id, coalesce(name, label)) group by id", SIGHTINGS, _FINDINGS)
def ev_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_findings(spark, sf_dir))


_TALLY = "select case outcome when 'named' then 'named' when 'not an animal' then 'relabelled' when 'still unnamed' then 'relabelled' when 'unknown' then 'unknown' else 'skipped' end as tally, count(*) as n from ({}) group by 1".format


@query(_TALLY(RECLASSIFIED), SIGHTINGS)
def ev_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tally of classifying all stored animals again."""
    return evaluate.outcomes(sp_reclassified(spark, sf_dir))


@query(_TALLY(RECLASSIFIED_KEPT), SIGHTINGS)
def ev_outcomes_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tally where animals that stay unnamed stay animals."""
    return evaluate.outcomes(reclassified_animals(spark, sf_dir, still_as_motion=False))
