"""Evaluation of settings against reviewed cases: what is expected, what was found, and whether anything got worse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_name


def expected(events: DataFrame) -> DataFrame:
    """What each event should give: want_label (null for nothing), want_species if one is known, and what must be gone:
    not_label, the stored label that a reviewer corrected, and not_species, the stored name of an animal that a reviewer
    marked as one without giving its name. A review counts before what was stored; "nothing" and motion expect no object."""
    said, stored = F.col("feedback"), F.col("label")
    label = F.coalesce(said, stored)
    label = F.when(~label.isin("nothing", "motion"), label)
    species = F.when(label == "animal", F.when(said.isNull(), F.col("common_name")).otherwise(F.col("feedback_species")))
    not_label = F.when(label.isNotNull() & (said != stored) & (stored != "motion"), stored)
    not_species = F.when((label == "animal") & (said == stored) & F.col("feedback_species").isNull(), F.col("common_name"))
    return events.select("*", label.alias("want_label"), species.alias("want_species"), not_label.alias("not_label"), not_species.alias("not_species"))


def met(found: Column, label: Column, species: Column, not_label: Column, not_species: Column, named: bool = True) -> Column:
    """Whether an array of (label, name) meets an expectation of expected(): no object for nothing; else one of the label,
    none of the label that must be gone, and, if names count (named), one of the known name and none of the wrong one. A
    name is met by one that holds it or is held by it."""
    of_label = lambda x: x["label"] == label
    called = lambda name: F.exists(found, lambda x: of_label(x) & same_name(F.coalesce(x["name"], F.lit("")), name))
    hit = F.exists(found, of_label) & (not_label.isNull() | ~F.exists(found, lambda x: x["label"] == not_label))
    if named:
        hit = hit & (species.isNull() | called(species)) & (not_species.isNull() | ~called(not_species))
    return F.when(label.isNull(), ~F.exists(found, lambda x: x["label"] != "motion")).otherwise(hit)


def judged(events: DataFrame, findings: DataFrame, named: bool = True) -> DataFrame:
    """id, camera_id, marked, what expected() gives, passed: each case against its findings (id, label, name)."""
    per_case = findings.groupBy("id").agg(F.collect_list(F.struct("label", "name")).alias("found"))
    cases = expected(events).join(per_case, "id", "left")
    none = F.array().cast("array<struct<label:string,name:string>>")
    wants = ("want_label", "want_species", "not_label", "not_species")
    return cases.select("id", "camera_id", "marked", *wants, met(F.coalesce("found", none), *map(F.col, wants), named=named).alias("passed"))


def scorecard(run: DataFrame) -> DataFrame:
    """Per camera, and for all (null): marked cases that are right and wrong, unmarked ones that are the same and changed."""
    n = lambda c, alias: F.count_if(c).alias(alias)
    return run.rollup("camera_id").agg(n(F.col("marked") & F.col("passed"), "fixed"), n(F.col("marked") & ~F.col("passed"), "wrong"), n(~F.col("marked") & F.col("passed"), "same"), n(~F.col("marked") & ~F.col("passed"), "changed"))


def compared(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """How many cases are better, worse, alike or new against an earlier run."""
    both = run.join(baseline.select("id", F.col("passed").alias("before")), "id", "left")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("passed") & ~F.col("before"), "better").when(~F.col("passed") & F.col("before"), "worse").otherwise("alike")
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def summary(findings: DataFrame) -> DataFrame:
    """id and its distinct texts in the order they were first found, with how often: "person ×2, Red fox"."""
    text = F.coalesce("name", "label")
    each = findings.groupBy("id", text.alias("text")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    said = F.when(F.col("n") > 1, F.concat("text", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("text"))
    return each.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", said.alias("said")))), lambda x: x["said"]), ", ").alias("summary"))


def outcomes(answers: DataFrame) -> DataFrame:
    """The tally of a run of species.reclassified() (column outcome): how many events it named, relabelled (as no animal, or
    as motion because they stay unnamed), left without a confident answer, or skipped because no animal was found."""
    kind = F.when(F.col("outcome") == "named", "named").when(F.col("outcome").isin("not an animal", "still unnamed"), "relabelled").when(F.col("outcome") == "unknown", "unknown").otherwise("skipped")
    return answers.groupBy(kind.alias("tally")).agg(F.count("*").alias("n"))
