"""Mixing sources to target weights: a token budget handed down a tree of domain, language and source.

Each node's share is its weight among its siblings. What a node can't use, because its documents run out even after the
allowed epochs, goes first to its siblings in proportion to their weights, and only what they can't take goes up to the
siblings of its parent. Each leaf then gives whole epochs, and of the last one the documents that come first in an order
seeded by the epoch, as long as their tokens fit the leaf's budget.

Budgets are shared out level by level over the tree's nodes, in windows over the children of each node; the tree isn't
gathered anywhere. The order is a hash of seed, document and epoch. Tokens are summed by the hash's leading bits to find the
slot of hashes where a leaf's budget ends, then by the next bits within that slot. Only rows of the last slot, one in a
million of a leaf, are put in order, never a whole leaf.

Cases: null sources and languages are nodes named "" of their own; null or empty texts have no tokens and go with any
prefix that reaches them; long texts count whole; ties of the hash go by text, and rows equal in id and text are selected
together or not at all; nodes without weight get nothing; without documents, or with a budget of 0, nothing is selected.
Extra columns are kept where keep asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import space_words, stored

#: Tokens are summed by so many bits of the hash at a time, in so many rounds.
SLOT_BITS, ROUNDS = 10, 2
#: Bits of an order: 15 digits of a hash in hexadecimal.
ORDER_BITS = 60
#: The mix that the query and the pipeline aim at: weights of languages and of kinds of source.
MIX = {"en": 3.0, "de": 2.0, "fr": 2.0, "es": 1.0, "src-7": 2.0, "src-0": 0.5}
#: The levels of the tree below its root.
LEVELS = ["__domain", "__lang", "__source"]


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent's columns, name, budget of the parent, weight, most: the tokens it can use) with its part of the budget in
    whole tokens. Nodes that their share fills, in order of what they can use for their weight, leave the rest to the others."""
    w = F.col("weight")
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    filling = siblings.orderBy(F.col("most") / w, name)
    up = filling.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.where((w > 0) & (F.col("most") > 0))
    nodes = nodes.withColumn("budget", F.least("budget", F.sum("most").over(siblings)))
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(up), F.lit(0)))
    # Weights still open from this node on, summed from the end so that nothing is lost to subtraction.
    nodes = nodes.withColumn("open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    nodes = nodes.withColumn("full", F.col("left") * w >= F.col("most") * F.col("open"))
    nodes = nodes.withColumn("full", F.min("full").over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(siblings), F.lit(0))
    total = F.max(F.when(~F.col("full"), F.col("open"))).over(siblings)
    nodes = nodes.withColumn("rest", rest).withColumn("want", F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest * w / total))
    nodes = nodes.withColumn("whole", F.floor("want")).withColumn("over", F.col("rest") - F.sum(F.when(~F.col("full"), F.col("whole"))).over(siblings))
    # Single tokens left by rounding, to the largest remainders first.
    turn = F.row_number().over(siblings.orderBy("full", F.col("whole") - F.col("want"), name))
    return nodes.withColumn("part", F.col("whole") + (~F.col("full") & (turn <= F.col("over"))).cast("long")).select(*parent, name, "part")


def budgets(leaves: DataFrame, fraction: float, epochs: int, weights: dict[str, float]) -> DataFrame:
    """LEVELS, n, part: the budget of each leaf (LEVELS, n tokens): siblings fill up for each other before anything goes back to
    an ancestor's siblings."""
    weight_of = F.lit(1.0)
    for name, weight in weights.items():
        weight_of = F.when(F.col("__name") == name, F.lit(float(weight))).otherwise(weight_of)
    plan = leaves.agg(F.floor(F.sum("n") * fraction).alias("budget"))
    for k, name in enumerate(LEVELS):
        parent = LEVELS[:k]
        nodes = leaves.groupBy(*parent, name).agg((F.sum("n") * epochs).alias("most")).withColumn("__name", F.col(name))
        nodes = nodes.join(plan, parent) if parent else nodes.join(F.broadcast(plan), F.lit(True))
        plan = share_out(nodes.withColumn("weight", weight_of), parent, name).withColumnRenamed("part", "budget")
    return leaves.join(plan.withColumnRenamed("budget", "part"), LEVELS)


def domain_of(source: Column) -> Column:
    """The source's name without its number, with the number's last digit as the kind: src17 belongs to domain src-7."""
    return F.concat_ws("-", F.regexp_extract(F.coalesce(source, F.lit("")), "^([^0-9]*)", 1), F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1))


def select(docs: DataFrame, fraction: float = 0.5, epochs: int = 2, weights: dict[str, float] | None = None, seed: int = 17, keep: tuple[str, ...] = ("doc_id",), domain: Column | None = None) -> DataFrame:
    """keep, domain, lang, source, n_tokens, epoch: one row for each document and epoch selected.

    fraction: the budget as a share of all tokens (words). epochs: how often a document may be used at most. weights: of
    domains, languages and sources by name, 1 where not given.
    """
    key = LEVELS
    own = ["__doc", "__text", "n_tokens"]
    named = docs.select(
        *keep,
        F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("")).alias("__domain"),
        F.coalesce("lang", F.lit("")).alias("__lang"),
        F.coalesce("source", F.lit("")).alias("__source"),
        F.size(space_words(F.col("text"))).cast("long").alias("n_tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__doc"),
        F.xxhash64("text").alias("__text"),
    )
    slim = stored(named if keep == ("doc_id",) else named.select(*key, *own), "mixing-tokens")
    leaves = stored(slim.groupBy(*key).agg(F.sum("n_tokens").alias("n")), "mixing-leaves")
    plan = budgets(leaves, fraction, epochs, weights or {}).where("part > 0")
    # A row for each leaf; Spark broadcasts it where that is small.
    plan = stored(plan.select(*key, F.floor(F.col("part") / F.col("n")).alias("whole"), (F.col("part") % F.col("n")).alias("rest")), "mixing-plan")

    def ordered(df: DataFrame) -> DataFrame:
        """With the place in the seeded order of the epoch that the leaf uses in part."""
        said = F.concat_ws(":", F.lit(seed), "__doc", "whole")
        df = df.join(plan, key).withColumn("__order", F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long"))
        return df.withColumn("__place", F.struct("__order", "__doc", "__text"))

    def slot(rounds: int) -> Column:
        return F.shiftright("__order", ORDER_BITS - SLOT_BITS * rounds)

    inside = ordered(slim).where("rest > 0").withColumn("before", F.lit(0).cast("long"))
    for k in range(1, ROUNDS + 1):
        sums = inside.groupBy(*key, "rest", "before", slot(k).alias("__end")).agg(F.sum("n_tokens").alias("n"))
        earlier = Window.partitionBy(*key).orderBy("__end").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        ends = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).select(*key, "__end", "before")
        ends = stored(ends, "mixing-ends")  # a row for each leaf at most, as is cuts
        inside = ordered(slim).join(ends, key).where(slot(k) == F.col("__end"))
    running = Window.partitionBy(*key).orderBy("__place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running))
    cuts = stored(edge.groupBy(*key, "__end").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("__place"))).alias("__cut")), "mixing-cuts")

    rows = ordered(slim if keep == ("doc_id",) else named).join(cuts, key, "left")
    last = (slot(ROUNDS) < F.col("__end")) | (slot(ROUNDS) == F.col("__end")) & F.coalesce(F.col("__place") <= F.col("__cut"), F.lit(False))
    rows = rows.withColumn("__n", F.col("whole") + F.coalesce(last, F.lit(False)).cast("long")).where("__n > 0")
    named_too = [F.col(f"__{c}").alias(c) for c in ("domain", "lang", "source") if c not in keep]
    return rows.select(*keep, *named_too, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("epoch"))
