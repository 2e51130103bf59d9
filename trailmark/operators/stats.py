"""Chart queries: counts by label, species, hour and camera, and animal counts corrected by reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapter import LABELS


def label_order(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LABELS)), c).cast("int")


def by_label(events: DataFrame, zero_filled: bool = False) -> DataFrame:
    """label, n. Absent labels are left out, or have 0 in display order."""
    counts = events.groupBy("label").agg(F.count("*").alias("n"))
    if not zero_filled:
        return counts
    domain = events.sparkSession.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "place int, label string")
    counts = F.broadcast(counts.where(F.col("label").isin(*LABELS)))  # a row for each label
    return domain.join(counts, "label", "left").select("place", "label", F.coalesce("n", F.lit(0)).alias("n"))


def by_species(events: DataFrame) -> DataFrame:
    """Per lower-cased name: its first event's names, count, last time, and the best event.

    The best is the first event until a later one has a higher score and a ready clip; so it is the highest score among
    ready events above the first's score, the earliest of equals, else the first. Unnamed animals are one group, which
    goes by the detector's score. Both steps are partial aggregates, so a name with most of the animals is no hot key; the
    first step's result, a row for each name, is joined in between.
    """
    score = F.coalesce("species_score", "top_score")
    e = events.where("label = 'animal'").select("id", "started_at", "clip_state", "common_name", "scientific_name", F.lower("common_name").alias("__key"), score.alias("__score"))
    order = F.struct("started_at", "id")
    first = F.min_by(F.struct("__score", "common_name", "scientific_name"), order)
    names = e.groupBy(F.col("__key").alias("__name")).agg(first.alias("f"), F.count("*").alias("n"), F.max("started_at").alias("last_seen"))
    e = e.join(names, e["__key"].eqNullSafe(names["__name"]))
    better = (F.col("clip_state") == "ready") & (F.col("__score") > F.col("f.__score"))
    best = F.min_by(F.struct("id", "__score"), F.struct((~better).cast("int"), F.when(better, -F.col("__score")), "started_at", "id"))
    return e.groupBy("__key").agg(F.any_value("f").alias("f"), F.any_value("n").alias("n"), F.any_value("last_seen").alias("last_seen"), best.alias("b")).select(
        F.col("f.common_name").alias("common_name"), F.col("f.scientific_name").alias("scientific_name"), "n", "last_seen", F.col("b.id").alias("best_id"), F.col("b.__score").alias("best_score")
    )


def overview(events: DataFrame) -> DataFrame:
    """chart (label, species, hour, camera), name, n: all counts of a start page from one scan. Species are those of animals
    by lower-cased name, null for the unnamed ones."""
    rows = events.select("label", "local_hour", "camera_id", F.when(F.col("label") == "animal", F.lower("common_name")).alias("key"), (F.col("label") == "animal").alias("is_animal"))
    by = [F.col(c) for c in ("label", "local_hour", "camera_id", "key", "is_animal")]
    counts = rows.groupingSets([by[:1], by[1:2], by[2:3], by[3:]], *by).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"__{c}") for c in ("label", "local_hour", "camera_id", "is_animal")))
    counts = counts.where("__is_animal = 1 or is_animal")
    chart = F.when(F.col("__label") == 0, "label").when(F.col("__local_hour") == 0, "hour").when(F.col("__camera_id") == 0, "camera").otherwise("species")
    return counts.select(chart.alias("chart"), F.coalesce("label", F.col("local_hour").cast("string"), "camera_id", "key").alias("name"), "n")


def hours(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("local_hour"))


def hourly(events: DataFrame) -> DataFrame:
    """All 24 local hours with a count of each label."""
    counts = events.groupBy("local_hour").pivot("label", list(LABELS)).count()
    return hours(events.sparkSession).join(counts, "local_hour", "left").fillna(0)


def cameras_today(events: DataFrame, cameras: tuple[str, ...]) -> DataFrame:
    """Every configured camera with its counts by label, 0 where it saw nothing."""
    counts = events.groupBy("camera_id").pivot("label", list(LABELS)).count()
    domain = events.sparkSession.createDataFrame([(c,) for c in cameras], "camera_id string")
    return domain.join(counts, "camera_id", "left").fillna(0)


def corrected(events: DataFrame) -> DataFrame:
    """Animals after review: an animal that nobody marked, or anything marked as an animal. A mark counts before what the
    model said: its animal has the species that the reviewer gave, without a scientific name, or no name at all."""
    said = F.col("feedback")
    animal = F.when(said.isNull(), F.col("label") == "animal").otherwise(said == "animal")
    named = F.when(said.isNull(), F.col("common_name")).otherwise(F.col("feedback_species"))
    scientific = F.when(said.isNull(), F.col("scientific_name")).when(F.col("feedback_species").isNotNull(), "")
    return events.where(animal).select("*", named.alias("animal"), scientific.alias("animal_scientific"))


def tally(events: DataFrame) -> DataFrame:
    """Corrected animals by lower-cased name: count, the first non-empty scientific name (else an empty one), last time, counts by hour."""
    e = corrected(events).where("animal is not null")
    order = F.struct("started_at", "id")
    return e.groupBy(F.lower("animal").alias("key")).agg(
        F.min_by("animal", order).alias("animal"),
        F.count("*").alias("n"),
        F.coalesce(F.min_by("animal_scientific", F.when(F.col("animal_scientific") != "", order)), F.lit("")).alias("scientific_name"),
        F.max("started_at").alias("last_seen"),
        F.array(*(F.count_if(F.col("local_hour") == h) for h in range(24))).alias("by_hour"),
    )


def unidentified(events: DataFrame) -> DataFrame:
    return corrected(events).agg(F.count_if(F.col("animal").isNull()).alias("unidentified"), F.count("*").alias("animals"))


def top_and_rest(counts: DataFrame, name: str, n: str, most: int) -> DataFrame:
    """The most frequent names and one row with the sum of all others. counts has a row for each name."""
    best = counts.orderBy(F.desc(n), name).limit(most).select(name, n)
    rest = counts.join(best.select(name), name, "left_anti").agg(F.count("*").alias("k"), F.sum(n).alias(n)).where("k > 0")
    return best.unionByName(rest.select(F.concat(F.lit("Other ("), F.col("k").cast("string"), F.lit(")")).alias(name), n))


def hour_totals(events: DataFrame) -> DataFrame:
    """Counts by hour and label with all subtotals; null stands for all."""
    return events.cube("local_hour", "label").agg(F.count("*").alias("n"))
