"""Quality rules: a decision list learned by sequential covering and applied as one Spark expression.

Documents are reduced to a few counts (`measure`), the counts of labelled documents to bins, and each step of the search
to one small table of (feature, bin, positives, negatives). The driver sees only those tables; texts stay on executors.

Cases: a null or empty text has no words, so all its counts are 0 and it fails the base rule; null ids and labels without
a document are kept out of the training, and of several labels of one document the lowest counts; very long texts are
measured whole; of conditions that gain about as much the one with the fewest negatives is taken, then the strictest border, then
the first feature by name, and of rules the first that fires; repeated rows give repeated results; without labelled documents of both kinds no
rule is learned and the base rule alone decides. Extra columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, space_words, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "word_length", "n_words")


def repeat_words(words: Column, n_words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. words has to be a plain column: lambdas read it again and again."""
    grams = F.when(n_words >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n_words - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    return grams


def covered(hits: Column) -> Column:
    """The size of the union of [p, p + 2] over sorted positions."""
    step = F.aggregate(
        hits,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
    )
    return step["n"]


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the counts of COUNTS, and what else the features need; one row for each row of docs, without a shuffle."""
    blank_free = f"[^{SPACE}]"
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    d = d.withColumn("__words", space_words(F.col("__text"))).withColumn("n_words", F.size("__words"))
    d = d.withColumn("__grams", repeat_words(F.col("__words"), F.col("n_words")))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(blank_free)))
    d = d.withColumn("__sorted", F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("__sorted") - 1
    same = lambda i, j: F.get("__sorted", i)["h"] == F.get("__sorted", j)["h"]
    at = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))) | ((i < last) & F.coalesce(same(i, i + 1), F.lit(False))))
    d = d.withColumn("__hits", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.transform(at, lambda i: F.get("__sorted", i)["i"]))))
    return d.select(
        *keep,
        F.col("n_words").cast("long"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(F.col("__hits")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count("__text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit("[!?]")).cast("long").alias("n_marks"),
    )


def features() -> dict[str, Column]:
    """The features that rules compare with thresholds, as expressions over measure()."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def learn(measured: DataFrame, labels: DataFrame, label: str = "quality", bins: int = 24, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_support: int = 8, slack: float = 0.01, key: str = "doc_id") -> list[Rule]:
    """Rules whose documents are of low quality (label 0), most useful first.

    Two thirds of the labelled documents grow conjunctions, by the largest gain of information over every (feature, bin
    border, direction); one third prunes them, by (p - n) / (p + n) of each prefix. A rule stays if the pruning third
    gives it a Laplace-smoothed precision of min_precision or more; what a rule covers is taken away before the next.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__label"))
    fits = features()
    rows = measured.join(known, key).select(*COUNTS, "n_lines", "n_upper", "n_marks", (F.col("__label") == 0).cast("long").alias("__p"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("__prune"))
    # What the base rule refuses needs no other rule.
    rows = stored(rows.where(~base_failed()), "rules-labelled")
    # Quantiles of either kind, so that a kind which is rare or has one usual value still gives borders of its own.
    marks = [i / bins for i in range(bins)]
    cuts = rows.groupBy("__p").agg(*(F.percentile_approx(c, marks, 10_000).alias(f) for f, c in fits.items())).collect()
    borders = {f: sorted({x for row in cuts for x in row[f] or []}) for f in fits}
    borders = {f: b for f, b in borders.items() if b}
    if not borders:
        return []
    slot = lambda f: reduce(lambda acc, x: acc + (fits[f] > F.lit(x)).cast("int"), borders[f], F.lit(0))
    rows = stored(rows.select("*", *(slot(f).alias(f"__{f}") for f in borders)), "rules-binned")
    held = lambda c: (F.col(f"__{c.feature}") > borders[c.feature].index(c.threshold)) if c.above else (F.col(f"__{c.feature}") <= borders[c.feature].index(c.threshold))
    match = lambda rule: _all([held(c) for c in rule])

    def table(covered_by: list[Rule], rule: Rule) -> dict[str, list[tuple[int, int, int]]]:
        left = rows.where(~F.col("__prune") & match(rule) & ~_any([match(r) for r in covered_by]))
        slots = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"__{f}").alias("b")) for f in borders)))
        out: dict[str, list[tuple[int, int, int]]] = {f: [] for f in borders}
        for r in left.select(slots.alias("s"), "__p").groupBy("s.f", "s.b").agg(F.sum("__p").alias("p"), F.sum(1 - F.col("__p")).alias("n")).collect():
            out[r["f"]].append((r["b"], r["p"], r["n"]))
        return out

    def gain(p: int, n: int, p0: int, n0: int) -> float:
        return p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = table(rules, rule)
            p0, n0 = (sum(x[i] for x in next(iter(counts.values()))) for i in (1, 2))
            if p0 < min_support or not n0:
                break
            tried: list[tuple[float, int, float, Condition]] = []
            for f, cells in sorted(counts.items()):
                for k, border in enumerate(borders[f]):
                    for above in (True, False):
                        inside = [x for x in cells if (x[0] > k) == above]
                        p, n = sum(x[1] for x in inside), sum(x[2] for x in inside)
                        if p >= min_support and (p, n) != (p0, n0) and (g := gain(p, n, p0, n0)) > 1e-9:
                            tried.append((g, -n, border if above else -border, Condition(f, above, border)))
            if not tried:
                break
            # Of conditions that are about as good, the one that spares most: fewest negatives, then the strictest border.
            good = max(t[0] for t in tried) * (1 - slack)
            rule = (*rule, max((t for t in tried if t[0] >= good), key=lambda t: t[1:3])[3])
        if not rule:
            break
        free = ~_any([match(r) for r in rules])
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        cells = [c for r in prefixes for c in (F.sum(F.when(match(r), F.col("__p"))), F.sum(F.when(match(r), 1 - F.col("__p"))))]
        got = rows.where(F.col("__prune") & free).select(*(F.coalesce(c, F.lit(0)).alias(f"c{i}") for i, c in enumerate(cells))).first()
        worth = [(got[2 * i], got[2 * i + 1]) for i in range(len(prefixes))]
        k = max(range(len(prefixes)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), -i))
        p, n = worth[k]
        if (p + 1) / (p + n + 2) < min_precision:
            break
        rules.append(prefixes[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The rules as an ordered conditional: the number of the first that fires (from 1), 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all([c.column() for c in rule]), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """keep, the counts, base_failed, rule (number of the learned rule that fired, 0 for none), kept. Texts are measured once."""
    measured = stored(measure(docs, keep), "rules-measured")
    rules = learn(measured, labels, **options)
    return measured.select(*keep, *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
