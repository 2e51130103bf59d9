"""URL filters: a curated rule list, and path templates learned from the URLs that the list decides.

The list's verdicts label the URLs it fits. For the rest, paths become templates in a tree per host, level by level: a
segment that holds an identifier becomes its type, and a segment that few of its parent's URLs have becomes a wildcard,
below which the URLs of all such segments lie together. A branch with fewer URLs than min_count isn't followed further;
what comes below it is "**". The templates below one parent, at most 1 / min_share of them and two wildcards, are merged
where their labelled block rates don't differ significantly from the pooled rate of those merged before, in order of their
rates. A merged branch's rate is smoothed towards that of the same templates in all hosts, and that towards the overall
rate; a template is refused where the smoothed rate reaches a threshold.

All counts are partial aggregates by host, branch and segment; no step puts the URLs or paths of a host in one task.

Cases: null URLs and URLs without :// have an empty host and path, fit no rule and have the root template; repeated rows
give repeated results; long URLs count whole, with one round of counting for each level that has a branch to follow;
branches with equal rates go by name; without labelled URLs every rate is the prior, which allows; an empty table gives no
rows. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: The base list of the contract.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: A list longer than this is no longer one expression of sensible size.
MOST_RULES = 500


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for null or without ://."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    # The host holds none of / ? #, so what comes after it is found by another group of the same pattern.
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of equal lengths the one that sorts first), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def generalised(segment: Column) -> Column:
    """A segment with its variable part as a wildcard: digits, long hexadecimal strings, and what mixes letters with digits."""
    name, suffix = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", ""), F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0)
    return (
        F.when(name.rlike(r"^[0-9]+$"), F.concat(F.lit("<number>"), suffix))
        .when(name.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), F.concat(F.lit("<hex>"), suffix))
        .when(name.rlike(r"[0-9]"), F.concat(F.lit("<mixed>"), suffix))
        .otherwise(segment)
    )


def tree(cells: DataFrame, min_share: float, min_count: int) -> DataFrame:
    """cells (host, segments, n, b, a) with template and above, the template of its parent."""
    cells = stored(cells.select("*", F.lit("").alias("above"), F.lit("").alias("template"), (F.size("segments") > 0).alias("open")), "url-cells")
    level = 0
    while not cells.where("open").isEmpty():
        at = F.when(F.col("open"), F.get("segments", F.lit(level)))
        below = cells.where("open").groupBy("host", "template", at.alias("segment")).agg(F.sum("n").alias("own"))
        parents = below.groupBy("host", "template").agg(F.sum("own").alias("total"))
        often = (F.col("own") >= min_count) & (F.col("own") >= min_share * F.col("total"))
        step = F.when(F.col("total") < min_count, "**").when(often, F.col("segment")).otherwise("*")
        steps = below.join(parents, ["host", "template"]).select("host", "template", "segment", step.alias("step"))
        moved = cells.withColumn("segment", at).join(steps, ["host", "template", "segment"], "left")
        went = F.col("step").isNotNull()
        cells = moved.select(
            *("host", "segments", "n", "b", "a"),
            F.when(went, F.col("template")).otherwise(F.col("above")).alias("above"),
            F.when(went, F.concat("template", F.lit("/"), "step")).otherwise(F.col("template")).alias("template"),
            (went & (F.col("step") != "**") & (F.size("segments") > level + 1)).alias("open"),
        )
        cells = stored(cells, "url-cells")
        level += 1
    return cells


def merged(branches: DataFrame, z: float, prior: float) -> DataFrame:
    """host, template, block_rate: of the templates below one parent (host, above, template, n, b, a, p0), the smoothed rate of
    the group that each is merged into."""
    weight = lambda g: g["said"] + prior
    rate = lambda g: (g["b"] + prior * g["p"] / g["n"]) / weight(g)
    one = F.struct(F.col("b").cast("double").alias("b"), (F.col("b") + F.col("a")).cast("double").alias("said"), (F.col("p0") * F.col("n")).alias("p"), F.col("n").cast("double").alias("n"), F.array("template").alias("names"))
    rows = branches.select("host", "above", "template", one.alias("one"))
    rows = rows.select("host", "above", F.struct(rate(F.col("one")).alias("rate"), "template", "one").alias("branch"))
    groups = rows.groupBy("host", "above").agg(F.sort_array(F.collect_list("branch")).alias("branches"))

    def add(done: Column, branch: Column) -> Column:
        last, new = F.try_element_at(done, F.lit(-1)), branch["one"]
        pooled = (rate(last) * weight(last) + rate(new) * weight(new)) / (weight(last) + weight(new))
        error = F.sqrt(pooled * (1 - pooled) * (1 / weight(last) + 1 / weight(new)))
        both = F.struct(*((last[c] + new[c]).alias(c) for c in ("b", "said", "p", "n")), F.concat(last["names"], new["names"]).alias("names"))
        alike = (F.size(done) > 0) & (F.abs(rate(new) - rate(last)) <= z * error)
        return F.when(alike, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(new)))

    none = F.array().cast("array<struct<b:double,said:double,p:double,n:double,names:array<string>>>")
    groups = groups.select("host", F.explode(F.aggregate("branches", none, add)).alias("g"))
    return groups.select("host", F.explode("g.names").alias("template"), rate(F.col("g")).alias("block_rate"))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, min_share: float = 0.01, min_count: int = 8, z: float = 2.0, prior: float = 4.0, threshold: float = 0.7) -> DataFrame:
    """page_id, host, path, rule, verdict, template, block_rate.

    Below a parent, a segment with less than min_share of the parent's URLs, or fewer than min_count, is a wildcard. z:
    standard errors by which a branch's rate may differ from those it is merged with. prior: the weight, in URLs, of the rate
    smoothed towards.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    blocking = [r for r, said in rules.items() if said == "block"]
    urls = urls.withColumn("listed", F.when(F.col("rule").isin(blocking), "block").when(F.col("rule").isNotNull(), "allow"))
    urls = urls.withColumn("segments", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), generalised))

    # One row for each host and typed path from here on; a busy host's rows meet in as many cells as it has shapes.
    counts = urls.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(F.col("listed") == "block").alias("b"), F.count_if(F.col("listed") == "allow").alias("a"))
    cells = tree(counts, min_share, min_count)
    leaves = cells.groupBy("host", "above", "template").agg(*(F.sum(c).alias(c) for c in ("n", "b", "a")))

    # Prior rates: of the template in all hosts, smoothed towards the rate of all. Rates start from one URL of either kind.
    overall = leaves.agg(F.sum("b").alias("gb"), F.sum("a").alias("ga"))
    everywhere = leaves.groupBy("template").agg(F.sum("b").alias("tb"), F.sum("a").alias("ta")).join(F.broadcast(overall), F.lit(True))
    everywhere = everywhere.select("template", ((F.col("tb") + prior * (F.col("gb") + 1) / (F.col("gb") + F.col("ga") + 2)) / (F.col("tb") + F.col("ta") + prior)).alias("p0"))
    rates = merged(leaves.join(everywhere, "template"), z, prior)

    # Typed paths with their verdicts, joined to the pages; both sides of this join can be split where a host is busy.
    decided = cells.select("host", "segments", "template").join(rates, ["host", "template"])
    out = urls.join(decided, ["host", "segments"])
    learned = F.when(F.col("block_rate") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    template = F.when(F.col("template") == "", "/").otherwise(F.col("template"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", learned).alias("verdict"), template.alias("template"), F.round("block_rate", 6).alias("block_rate"))
