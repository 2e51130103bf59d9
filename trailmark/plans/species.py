"""Species rules over the crops' class scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import species
from ..sources.adapter import LOGITS, TAXONOMY, logits, taxonomy, SIGHTINGS, unmarked_sightings
from .registry import query

#: A small geofence over the fixture's taxa, as taxon, allow, block.
RULES = [
    ("class0;order0;family1;genus2;species9", {"US": ["NY"]}, {}),
    ("class0;order0;family1;genus2;species10", {"CA": []}, {}),
    ("class0;order0;family1;genus2;species11", {}, {"US": []}),
    ("class1;order2;family4;genus8", {}, {"US": ["NY", "NJ"]}),
    ("class1;order3", {}, {"CA": []}),
]
_PROBS = "probs as (select event, weight, generate_subscripts(z, 1) - 1 as class, unnest(list_transform(z, lambda x: exp(x - list_max(z)))) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) as p from logits)"
_VOTES = "votes as (select event, cast(class as integer) as class, sum(p * greatest(weight, 1e-6)) / sum(greatest(weight, 1e-6)) as p from probs group by event, class)"
_TOP = "best as (select * from (select *, row_number() over (partition by event order by p desc, class) as place from votes) where place <= 5)"
_KEYS = "keys as (select class, 1 as level, concat_ws(';', t_class, t_order, t_family, t_genus) as taxon from taxonomy where t_class <> '' and common <> 'human' union all select class, 2, concat_ws(';', t_class, t_order, t_family) from taxonomy where t_class <> '' and common <> 'human' union all select class, 3, concat_ws(';', t_class, t_order) from taxonomy where t_class <> '' and common <> 'human' union all select class, 4, t_class from taxonomy where t_class <> '' and common <> 'human')"
#: The rules as one row for each place (a null region is all of a country), and what they keep out of New York.
_PLACES = ", ".join(f"('{taxon}', '{kind}', '{country}', {repr(region) if region else 'null'})" for taxon, allow, block in RULES for kind, places in (("allow", allow), ("block", block)) for country, regions in places.items() for region in (regions or [None]))
_HERE = "country = 'US' and (region is null or region = 'NY')"
_KEPT_OUT = f"kept_out as (select taxon from (values {_PLACES}) as k(taxon, kind, country, region) group by taxon having (count(*) filter (where kind = 'allow') > 0 and count(*) filter (where kind = 'allow' and {_HERE}) = 0) or count(*) filter (where kind = 'block' and {_HERE}) > 0)"
_UP = "up as (select event, level, taxon, p from (select *, row_number() over (partition by event order by level) as m from (select *, row_number() over (partition by event, level order by p desc, taxon) as r from (select event, level, taxon, sum(p) as p from best join keys using (class) where taxon not in (select taxon from kept_out) group by event, level, taxon)) where r = 1 and p > {least}) where m = 1)"
#: With 64 classes the fixture's scores are low, and so are its thresholds.
LEAST, CERTAIN = 0.1, 0.13
_VIEWS = (LOGITS, TAXONOMY, _PROBS, _VOTES, _TOP)


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "taxon string, allow map<string,array<string>>, block map<string,array<string>>")


@query("select event, class, place, round(p, 6) as p from best", *_VIEWS)
def ag_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species.top(species.vote(logits(spark, sf_dir))).select("event", "class", F.col("place").cast("long").alias("place"), F.round("p", 6).alias("p"))


@query("select event, case when sum(case when common in ('human', 'vehicle') then p else 0 end) > 0.08 then case when sum(case when common = 'vehicle' then p else 0 end) > sum(case when common = 'human' then p else 0 end) then 'vehicle' else 'person' end when sum(case when common = 'blank' then p else 0 end) > 0.04 then 'motion' end as said, sum(case when common = 'blank' then p else 0 end) >= 0.95 and sum(case when common = 'human' then p else 0 end) < 0.02 as person_not_there from votes join taxonomy using (class) group by event", *_VIEWS)
def ag_not_animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species.not_animals(species.vote(logits(spark, sf_dir)), taxonomy(spark), 0.08, 0.04)


@query("select event, level, taxon, round(p, 6) as p from up", *_VIEWS, _KEYS, _KEPT_OUT, _UP.format(least=0.12))
def ag_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept_out = species.blocked(_rules(spark), "US", "NY")
    return species.rolled_up(species.top(species.vote(logits(spark, sf_dir))), taxonomy(spark), kept_out, 0.12).select("event", "level", "taxon", F.round("p", 6).alias("p"))


def _assumed(key: str, group: str | None, name: str | None) -> str:
    return f"case when {key} = '{group}' or starts_with({key}, '{group};') then '{name}' end" if group else "cast(null as varchar)"


def _decided(least: float, certain: float, group: str | None = None, name: str | None = None) -> tuple[str, ...]:
    """The decision in steps: what is sure, what it may be in its place, and what the rest rolls up to."""
    return (
        f"""select event, how, case how when 'species' then coalesce(own, {_assumed('label', group, name)}, case when label = genus then local end, label) when 'local' then of_genus when 'group' then coalesce({_assumed('taxon', group, name)}, narrowed, taxon) end as name,
            round(case when how = 'group' then p when how is not null then p1 end, 6) as score
        from (select f.*, coalesce(f.way, case when u.taxon is not null then 'group' end) as how, u.taxon, u.p, n.species as narrowed from firsts f left join ups u using (event) left join local n on n.genus = u.taxon)""",
        *_VIEWS,
        _KEYS,
        _KEPT_OUT,
        "sp as (select class, t_class <> '' and common <> 'human' as animal, case when t_species <> '' then concat_ws(';', t_class, t_order, t_family, t_genus, t_species) end as own, case when t_genus <> '' then concat_ws(';', t_class, t_order, t_family, t_genus) end as genus from taxonomy)",
        "local as (select genus, min(own) as species from sp where own is not null and own not in (select taxon from kept_out) and animal group by genus having count(*) = 1)",
        f"""firsts as (
            select *, case when sure and not is_out then 'species' when sure and of_genus is not null then 'local' end as way
            from (select b.event, b.p as p1, sp.own, sp.genus, coalesce(sp.own, sp.genus) as label, l.species as local, coalesce({_assumed('sp.genus', group, name)}, l.species) as of_genus,
                coalesce(sp.own, sp.genus) in (select taxon from kept_out) as is_out, sp.animal and (b.p > {certain} or (b.p > {least} and b.event % 10 / 20.0 > 0.2)) as sure
                from best b join sp using (class) left join local l on l.genus = sp.genus where place = 1))""",
        f"""ups as (
            select event, min_by(taxon, level) as taxon, min_by(p, level) as p
            from (select event, level, taxon, p, row_number() over (partition by event, level order by p desc, entered desc) as r
                from (select event, level, taxon, sum(p) as p, min(place) as entered from best join keys using (class) where taxon not in (select taxon from kept_out) group by event, level, taxon))
            join (select event, case when sure then p1 - 1e-6 else {least} end as above, case when sure then 2 else 1 end as from_level from firsts where way is null) using (event)
            where r = 1 and level >= from_level and p > above group by event)""",
    )


def _decide(spark: SparkSession, sf_dir: str, assume: dict[str, str] | None = None) -> DataFrame:
    """Detector scores of the fixture go from 0 to 0.45 by event."""
    kept_out, z = species.blocked(_rules(spark), "US", "NY"), logits(spark, sf_dir)
    detector = z.select("event").distinct().withColumn("detector_score", F.col("event") % 10 / 20.0)
    return species.decide(species.vote(z), taxonomy(spark), kept_out, LEAST, detector, CERTAIN, assume=assume)


@query(*_decided(LEAST, CERTAIN))
def sp_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decide(spark, sf_dir)


@query(*_decided(LEAST, CERTAIN, "class0;order1;family2;genus4", "class0;order1;family2;genus4;species17"))
def sp_decide_assumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As sp_decide, with one species reported for all of a genus."""
    return _decide(spark, sf_dir, species.resolve_assume({"Genus4": "kind 17"}, taxonomy(spark)))


_CAP = "upper({0}[1]) || {0}[2:]".format


@query(
    f"select event, class, case when t_species <> '' then {_CAP('t_genus')} || ' ' || t_species when t_genus <> '' then {_CAP('t_genus')} else '' end as name, t_class = 'class1' and t_order = 'order2' as in_order, t_species = '' and t_family = 'family1' and t_genus <> '' and lower({_CAP('t_genus')}) = 'genus3' as is_group from best join taxonomy using (class)",
    *_VIEWS,
)
def sp_taxon_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scientific names of an event's best classes, and whether they belong to an order or are a genus by name."""
    ranks = [F.col(r) for r in (*species.RANKS, "t_species")]
    order = [F.lit("class1"), F.lit("order2"), F.lit(""), F.lit(""), F.lit("")]
    genus = F.broadcast(species.group_named(taxonomy(spark), " Genus3").select(F.col("class").alias("of"), F.lit(True).alias("is_group")))
    best = species.top(species.vote(logits(spark, sf_dir))).join(F.broadcast(taxonomy(spark)), "class").join(genus, F.col("class") == F.col("of"), "left")
    return best.select("event", "class", species.scientific_name(ranks).alias("name"), species.within(ranks, order).alias("in_order"), F.coalesce("is_group", F.lit(False)).alias("is_group"))


def _reclassified_sql(still_as_motion: bool = True) -> str:
    none, settled = ("'still unnamed'", "case when not moved then 'motion' end") if still_as_motion else ("'no animal'", "null")
    return f"select id, outcome, case outcome when 'still unnamed' then 'motion' when 'not an animal' then said end as new_label, case when said = 'motion' then 'motion' end as second_opinion from (select *, case when clip_path is null then {none} when common_name is not null then 'named' when coalesce(said, {settled}) = 'motion' and not moved then 'still unnamed' when said is not null then 'not an animal' else 'unknown' end as outcome from (select id, clip_path, common_name, case when clip_state = 'ready' then case cast(floor(top_score * 10) as integer) % 4 when 0 then 'animal' when 1 then 'person' when 2 then 'vehicle' end end as said0, case when said0 = 'person' then 'person' when said0 = 'vehicle' then 'motion' end as said, snapshot_path is not null as moved from sightings where label = 'animal'))"


RECLASSIFIED, RECLASSIFIED_KEPT = _reclassified_sql(), _reclassified_sql(False)


def reclassified_animals(spark: SparkSession, sf_dir: str, still_as_motion: bool = True) -> DataFrame:
    s = unmarked_sightings(spark, sf_dir).where("label = 'animal'")
    index = F.when(F.col("clip_state") == "ready", F.floor(F.col("top_score") * 10).cast("int") % 4)
    label = species.map_class(index)
    s = s.withColumn("said", F.when(label == "person", "person").when(label == "vehicle", "motion")).withColumn("moved", F.col("snapshot_path").isNotNull())
    outcome, new = species.reclassified(F.col("common_name"), F.col("said"), F.col("moved"), F.col("clip_path").isNotNull(), still_as_motion)
    return s.select("id", outcome.alias("outcome"), new.alias("new_label"), species.settle_person(F.col("said")).alias("second_opinion"))


@query(RECLASSIFIED, SIGHTINGS)
def sp_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What classifying stored animals again would change."""
    return reclassified_animals(spark, sf_dir)


@query(f"select id, new_label as label, case when outcome = 'named' then common_name end as species from ({RECLASSIFIED}) join (select id, common_name from sightings) using (id) where outcome in ('named', 'not an animal', 'still unnamed')", SIGHTINGS)
def sp_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of it would be stored."""
    rows = sp_reclassified(spark, sf_dir).join(unmarked_sightings(spark, sf_dir).where("label = 'animal'").select("id", "common_name"), "id")
    stored = rows.select("id", species.patch(F.col("outcome"), F.col("common_name"), F.col("new_label")).alias("p")).where("p is not null")
    return stored.select("id", "p.label", "p.species")
