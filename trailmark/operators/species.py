"""Species rules over class probabilities: votes of several crops, roll-up to taxa, geofence, narrowing by place."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ("t_class", "t_order", "t_family", "t_genus")
#: Levels of a roll-up, from genus (1) to class (4).
LEVELS = (1, 2, 3, 4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: a lambda's body would otherwise compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(z: Column) -> Column:
    def shares(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(powers, lambda e: e / total))

    return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), shares))


def vote(crops: DataFrame) -> DataFrame:
    """event, class, p: the weighted mean of the crops' probabilities (z holds scores before softmax), no weight below 1e-6."""
    w = F.greatest("weight", F.lit(1e-6))
    rows = crops.withColumn("p", softmax(F.col("z"))).select("event", w.alias("w"), F.posexplode("p").alias("class", "p"))
    return rows.groupBy("event", "class").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))


def top(votes: DataFrame, most: int = 5) -> DataFrame:
    """The most probable classes of an event with their place, the first of equals by class."""
    place = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("p"), "class"))
    return votes.withColumn("place", place).where(F.col("place") <= most)


def not_animals(votes: DataFrame, taxonomy: DataFrame, certain: float = 0.8, nothing: float = 0.9) -> DataFrame:
    """event and what the classifier says it is if no animal: a person or vehicle, motion for nothing there, else null;
    and whether it is sure that a person isn't there."""
    named = votes.join(F.broadcast(taxonomy.select("class", "common")), "class")
    share = lambda name: F.sum(F.when(F.col("common") == name, F.col("p")).otherwise(0.0))
    sums = named.groupBy("event").agg(share("blank").alias("blank"), share("human").alias("human"), share("vehicle").alias("vehicle"))
    said = F.when(F.col("human") + F.col("vehicle") > certain, F.when(F.col("vehicle") > F.col("human"), "vehicle").otherwise("person")).when(F.col("blank") > nothing, "motion")
    return sums.select("event", said.alias("said"), ((F.col("blank") >= 0.95) & (F.col("human") < 0.02)).alias("person_not_there"))


def taxon(level: Column) -> Column:
    """The key of a class's taxon at a level (0 for the species itself), null if a rank of it is empty."""
    ranks = F.array(*map(F.col, RANKS))
    kept = F.slice(ranks, F.lit(1), F.lit(len(RANKS) + 1) - F.greatest(level, F.lit(1)))
    key = F.array_join(kept, ";")
    key = F.when(level == 0, F.concat(key, F.lit(";"), F.col("t_species"))).otherwise(key)
    return F.when(~F.exists(kept, lambda r: r == "") & ((level > 0) | (F.col("t_species") != "")), key)


def blocked(rules: DataFrame, country: str | None, region: str | None) -> DataFrame:
    """taxon of every rule that keeps it from a place. rules: taxon, allow and block, maps of countries to regions. An empty
    allow map restricts nothing, a country without regions means all of it, and without a country nothing is kept out."""
    if country is None:
        return rules.select("taxon").limit(0)
    allowed, refused = F.try_element_at("allow", F.lit(country)), F.try_element_at("block", F.lit(country))
    here = F.lit(region).cast("string")
    outside = (F.size("allow") > 0) & (allowed.isNull() | (F.lit(region is not None) & (F.size(allowed) > 0) & ~F.array_contains(allowed, here)))
    inside = refused.isNotNull() & ((F.size(refused) == 0) | (F.lit(region is not None) & F.array_contains(refused, here)))
    return rules.where(F.coalesce(outside, F.lit(False)) | F.coalesce(inside, F.lit(False))).select("taxon")


def is_animal() -> Column:
    """Whether a taxonomy row is an animal by its names: not blank, a human, a vehicle, the general animal, or no result."""
    return (F.col("t_class") != "") & (F.col("common") != "human") & (F.col("t_class") != "no cv result")


def _level_best(best: DataFrame, taxonomy: DataFrame, kept_out: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """event, level, taxon, p: of each level the best taxon that isn't kept out, over an event's top classes that are animals;
    of equals the one that comes in last."""
    rows = best.join(F.broadcast(taxonomy.where(is_animal())), "class").withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("taxon", taxon(F.col("level")))
    sums = rows.where("taxon is not null").groupBy("event", "level", "taxon").agg(F.sum("p").alias("p"), F.min("place").alias("entered")).join(F.broadcast(kept_out), "taxon", "left_anti")
    order = Window.partitionBy("event", "level").orderBy(F.desc("p"), F.desc("entered"))
    return sums.withColumn("r", F.row_number().over(order)).where("r = 1").select("event", "level", "taxon", "p")


def rolled_up(best: DataFrame, taxonomy: DataFrame, kept_out: DataFrame, threshold: float, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """event, level, taxon, p: the first level whose best taxon that isn't kept out sums to more than the threshold."""
    above = _level_best(best, taxonomy, kept_out, levels).where(F.col("p") > threshold)
    return above.groupBy("event").agg(F.min_by(F.struct("level", "taxon", "p"), "level").alias("m")).select("event", "m.level", "m.taxon", "m.p")


def only_local(taxonomy: DataFrame, kept_out: DataFrame) -> DataFrame:
    """genus and its species, for genera of which exactly one species isn't kept out."""
    species = taxonomy.where(is_animal()).select(taxon(F.lit(1)).alias("genus"), taxon(F.lit(0)).alias("species")).where("species is not null and genus is not null")
    return species.join(kept_out, species["species"] == kept_out["taxon"], "left_anti").groupBy("genus").agg(F.count("*").alias("n"), F.min("species").alias("species")).where("n = 1").drop("n")


def decide(votes: DataFrame, taxonomy: DataFrame, kept_out: DataFrame, least: float, detector: DataFrame, certain: float = 0.8, agrees: float = 0.2, assume: dict[str, str] | None = None, narrow: bool = True) -> DataFrame:
    """event, how, name, score of every event with votes; how and name are null where nothing is decided.

    The top class is sure if it is an animal and more probable than certain, or than least where the detector's score
    (detector: event, detector_score) is above agrees. A sure class that may be there is the answer ("species"; a group is
    narrowed first). One that is kept out gives way to the species that its genus is narrowed to ("local"), else to the first
    group from its family up that is as probable ("group"). Without a sure class it is the first group from the genus up that
    is more probable than least ("group"). Groups are narrowed: to the species assumed for the nearest group above
    (assume, as resolve_assume() gives it), else, for a genus, to its only species that isn't kept out (narrow; pass False
    where no country is known).
    """
    best = top(votes)
    label = F.coalesce(taxon(F.lit(0)), *(taxon(F.lit(k)) for k in LEVELS))
    first = best.where("place = 1").join(F.broadcast(taxonomy), "class").select("event", F.col("p").alias("p1"), is_animal().alias("animal"), taxon(F.lit(0)).alias("own"), taxon(F.lit(1)).alias("genus"), label.alias("label"))
    local = only_local(taxonomy, kept_out).where(F.lit(narrow))
    first = first.join(F.broadcast(kept_out.select(F.col("taxon").alias("label"), F.lit(True).alias("out"))), "label", "left")
    first = first.join(F.broadcast(local.select("genus", F.col("species").alias("local"))), "genus", "left")
    first = first.join(detector.select("event", "detector_score"), "event", "left")
    seems = (F.col("p1") > certain) | ((F.col("p1") > least) & F.coalesce(F.col("detector_score") > agrees, F.lit(False)))
    first = first.withColumn("sure", F.col("animal") & seems & F.col("label").isNotNull()).withColumn("out", F.coalesce("out", F.lit(False)))
    of_genus = F.coalesce(assumed(F.col("genus"), assume), F.col("local"))
    first = first.withColumn("of_genus", of_genus)
    first = first.withColumn("how", F.when(F.col("sure") & ~F.col("out"), "species").when(F.col("sure") & F.col("of_genus").isNotNull(), "local"))
    # What is left rolls up: from the family on and to the top class's own score if that class is kept out.
    left = first.where("how is null").select("event", F.when(F.col("sure"), F.col("p1") - 1e-6).otherwise(least).alias("above"), F.when(F.col("sure"), 2).otherwise(1).alias("from_level"))
    levels = _level_best(best, taxonomy, kept_out, LEVELS).join(left, "event").where("level >= from_level and p > above")
    up = levels.groupBy("event").agg(F.min_by(F.struct("level", "taxon", "p"), "level").alias("m")).select("event", "m.level", "m.taxon", "m.p")
    up = up.join(F.broadcast(local.select(F.col("genus").alias("taxon"), F.col("species").alias("narrowed"))), "taxon", "left")
    both = first.join(up, "event", "left")
    how = F.coalesce("how", F.when(F.col("taxon").isNotNull(), "group"))
    sole = F.when(F.col("label") == F.col("genus"), F.col("local"))
    named = F.when(how == "species", F.coalesce("own", assumed(F.col("label"), assume), sole, "label")).when(how == "local", F.col("of_genus"))
    named = named.otherwise(F.coalesce(assumed(F.col("taxon"), assume), "narrowed", "taxon"))
    return both.select("event", how.alias("how"), named.alias("name"), F.round(F.when(how == "group", F.col("p")).when(how.isNotNull(), F.col("p1")), 6).alias("score"))


def within(ranks: list[Column], group: list[Column]) -> Column:
    """Whether a label is a group or one of its members: every rank that the group has is the same."""
    alike = reduce(lambda a, b: a & b, ((g == "") | (r == g) for r, g in zip(ranks, group, strict=True)))
    return (group[0] != "") & alike


def scientific_name(ranks: list[Column]) -> Column:
    """Genus and species, or the lowest rank that a label has, with a capital letter. ranks: class, order, family, genus, species."""
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000))
    out = F.lit("")
    for rank in ranks[:4]:
        out = F.when(rank != "", capital(rank)).otherwise(out)
    return F.when(ranks[4] != "", F.concat(capital(ranks[3]), F.lit(" "), ranks[4])).otherwise(out)


def group_named(taxonomy: DataFrame, name: str) -> DataFrame:
    """Labels of groups (no species) whose scientific or common name that is, whatever its case."""
    wanted = name.strip().lower()
    ranks = [F.col(r) for r in (*RANKS, "t_species")]
    return taxonomy.where((F.col("t_species") == "") & (F.col("t_class") != "") & ((F.lower(scientific_name(ranks)) == wanted) | (F.col("common") == wanted)))


def resolve_assume(assume: dict[str, str], taxonomy: DataFrame) -> dict[str, str]:
    """Names of groups and of the species to report for them, as taxon keys; unknown names and species outside their group
    are refused. The map is what a user writes down, so it stays small."""
    ranks = [F.col(r) for r in (*RANKS, "t_species")]
    out = {}
    for group_name, species_name in assume.items():
        group = group_named(taxonomy, group_name).first()
        if group is None:
            raise ValueError(f"{group_name!r} is not a group that the classifier knows")
        wanted = species_name.strip().lower()
        one = taxonomy.where((F.col("t_species") != "") & ((F.col("common") == wanted) | (F.lower(scientific_name(ranks)) == wanted)))
        found = one.select(taxon(F.lit(0)).alias("key"), within(ranks, [F.lit(group[r]) for r in (*RANKS, "t_species")]).alias("inside")).first()
        if found is None:
            raise ValueError(f"{species_name!r} is not a species that the classifier knows")
        if not found["inside"]:
            raise ValueError(f"{species_name!r} does not belong to {group_name!r}")
        out[";".join(r for r in (group[r] for r in RANKS) if r)] = found["key"]
    return out


def assumed(key: Column, assume: dict[str, str] | None) -> Column:
    """The species assumed for a taxon's genus, else its family, order or class; null if there is none."""
    out = F.lit(None).cast("string")
    for group, species in sorted((assume or {}).items(), key=lambda g: g[0].count(";")):
        out = F.when((key == group) | F.startswith(key, F.lit(group + ";")), F.lit(species)).otherwise(out)
    return out


def map_class(index: Column) -> Column:
    """The label of a detector's class; null for others."""
    return F.when(index == 0, "animal").when(index == 1, "person").when(index == 2, "vehicle")


def settle_still_animal(name: Column, said: Column, moved: Column, enabled: bool = True) -> Column:
    """What the classifier says instead of an animal (said), where it says nothing at all about a thing that didn't move: motion."""
    return F.when(name.isNull() & said.isNull() & F.lit(enabled) & ~moved, "motion").otherwise(said)


def settle_person(said: Column) -> Column:
    """A second opinion on a person changes it only to motion."""
    return F.when(said == "motion", said)


def reclassified(name: Column, said: Column, moved: Column, has_crops: Column, still_as_motion: bool = True) -> tuple[Column, Column]:
    """outcome and the label to store (null for none) of an animal event that is classified again."""
    settled = settle_still_animal(name, said, moved, still_as_motion)
    outcome = F.when(~has_crops, "still unnamed" if still_as_motion else "no animal").when(name.isNotNull(), "named")
    outcome = outcome.when((settled == "motion") & ~moved, "still unnamed").when(settled.isNotNull(), "not an animal").otherwise("unknown")
    return outcome, F.when(outcome == "still unnamed", "motion").when(outcome == "not an animal", settled)


def patch(outcome: Column, name: Column, label: Column) -> Column:
    """What an outcome of reclassified() stores, as a struct of label and species, each null if it stays; null if nothing changes."""
    return F.when(outcome.isin("named", "not an animal", "still unnamed"), F.struct(F.when(outcome != "named", label).alias("label"), F.when(outcome == "named", name).alias("species")))
