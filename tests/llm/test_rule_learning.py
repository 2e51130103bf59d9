"""The decision list's learner against a plain one, and a pipeline stage whose learned rule matters."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import quality_rules

COLUMNS = ("doc_id", *quality_rules.COUNTS, "n_lines", "n_upper", "n_marks")


def share(a, b):
    return a / b if b > 0 else 0.0


def plain_features(r):
    return {
        "symbol_share": share(r["n_symbols"], r["word_chars"]),
        "repeat_share": share(r["n_repeat_words"], r["n_words"]),
        "dup_line_share": share(r["n_dup_lines"], r["n_lines"]),
        "upper_share": share(r["n_upper"], r["word_chars"]),
        "mark_share": share(r["n_marks"], r["n_words"]),
        "word_length": share(r["word_chars"], r["n_words"]),
        "n_words": float(r["n_words"]),
    }


def plain_learner(rows, labels, pruned, bins=24, max_rules=6, max_conditions=3, min_precision=0.9, min_support=8, slack=0.01):
    """Conjunctions as tuples of (feature, above, border), grown and pruned row by row."""
    known = [(plain_features(r), labels[r["doc_id"]] == 0, r["doc_id"] in pruned) for r in rows if r["doc_id"] in labels and not (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])]
    borders = {}
    for kind in (True, False):
        of_kind = [x for x, bad, _ in known if bad == kind]
        for f in quality_rules.FEATURES:
            ordered = sorted(x[f] for x in of_kind)
            borders.setdefault(f, set()).update(ordered[max(1, math.ceil(len(ordered) * i / bins)) - 1] for i in range(bins if ordered else 0))
    fires = lambda rule, x: all((x[f] > b) == above for f, above, b in rule)
    left, rules = known, []
    while len(rules) < max_rules:
        rule, inside = (), [(x, bad) for x, bad, prune in left if not prune]
        while len(rule) < max_conditions:
            p0, n0 = sum(bad for _, bad in inside), sum(not bad for _, bad in inside)
            if p0 < min_support or not n0:
                break
            tried = []
            for f in sorted(borders):
                for b in sorted(borders[f]):
                    for above in (True, False):
                        p, n = (sum(1 for x, bad in inside if bad == kind and (x[f] > b) == above) for kind in (True, False))
                        gain = p * (math.log2((p + 1) / (p + n + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))
                        if p >= min_support and (p, n) != (p0, n0) and gain > 1e-9:
                            tried.append((gain, -n, b if above else -b, (f, above, b)))
            if not tried:
                break
            best = max(t[0] for t in tried) * (1 - slack)
            rule = (*rule, max((t for t in tried if t[0] >= best), key=lambda t: t[1:3])[3])
            inside = [(x, bad) for x, bad in inside if fires(rule, x)]
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):
            hit = [bad for x, bad, prune in left if prune and fires(rule[:k], x)]
            worth.append((sum(hit), len(hit) - sum(hit)))
        k = max(range(len(worth)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), -i))
        if (worth[k][0] + 1) / (sum(worth[k]) + 2) < min_precision:
            break
        rules.append(rule[: k + 1])
        left = [x for x in left if not fires(rules[-1], x[0])]
    return rules


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"min_precision": 0.7}), (3, {"min_precision": 0.6, "bins": 8, "max_conditions": 2}), (4, {"min_precision": 0.5, "min_support": 3})])
def test_learner_like_a_plain_one(spark, seed, options):
    rng = random.Random(seed)
    rows, labels = [], {}
    for i in range(1_200):
        n = rng.randint(30, 400)
        bad = rng.random() < 0.4
        kind = rng.choice("abc") if bad else ""
        rows.append((i, n, n * rng.randint(3, 9), rng.randint(40, 400) if kind == "a" else rng.randint(0, 60), rng.randint(0, 4), rng.randint(0, n // 3) if kind != "b" else n // 2, rng.randint(1, 20), rng.randint(0, n if kind == "c" else n // 5), rng.randint(0, 20)))
        if rng.random() < 0.8:
            labels[i] = int(not bad) if rng.random() < 0.97 else int(bad)
    measured = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in COLUMNS))
    # A label given twice counts once, and the lower of two; labels of no document and null ids count for nothing.
    given = [*labels.items(), *list(labels.items())[:20], (99_999, 0), (None, 0), (0, None)]
    table = spark.createDataFrame(given, "doc_id long, quality int")
    pruned = {r[0] for r in measured.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).select("doc_id").collect()}
    got = [tuple((c.feature, c.above, c.threshold) for c in rule) for rule in quality_rules.learn(measured, table, **options)]
    want = plain_learner([dict(zip(COLUMNS, r, strict=True)) for r in rows], labels, pruned, **options)
    assert got == want
    assert want


def test_a_learned_rule_takes_effect_in_the_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in ("an", "or", "ul") for c in ("ta", "rim", "sek", "os")]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    docs = [(i, text(80), "en", "s", 1) for i in range(240)] + [(1_000 + i, text(60) + " " + "$ # % & " * 12, "en", "s", 1) for i in range(160)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 1_000), 0) for i, *_ in docs if i % 4], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rule_stage(spark, table, str(tmp_path)).collect()}
    # Documents that the rule never saw a label of are judged by it, too.
    assert kept == set(range(240))
