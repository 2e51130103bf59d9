"""The pipeline, stage by stage and as a whole, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from tests.llm.test_corpus_operators import WORDS, brute_components, plain_mix
from tests.llm.test_text_operators import counts

import corpus_pipeline
from trailmark.llm import mixing, pieces, quality_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rule string, n_words long, votes string, comp long, domain string, ids string, __chunk long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with everything that may be odd about them, and labels too few to learn a rule from."""
    rng = random.Random(4)
    words = [f"{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'lmnopqrs'[i % 8]}{'aeiou'[i % 5]}rd{'abcdefghij'[i % 10]}" for i in range(900)]
    rows = []
    for i in range(90):
        own = rng.sample(words, 80)
        rows.append((i, " ".join(own), rng.choice(["en", "de", None]), f"src{i % 5}"))
        if i % 6 == 0:
            own[rng.randrange(80)] = "other"
            rows.append((1000 + i, " ".join(own), "en", "src7"))
    rows += [(2000 + i, "### $$$ %%% <> " * 30 + " ".join(rng.sample(words, 30)), "en", "src1") for i in range(25)]
    rows += [rows[0], rows[0], (5, "of the same id " + " ".join(rng.sample(words, 70)), "en", "src2"), (None, rows[3][1], None, None), (None, rows[3][1], None, None)]
    rows += [(3000, None, "en", "src1"), (3001, "", "en", "src1"), (3002, " ".join(rng.choice(words) + str(k % 97) for k in range(60_000)), "en", "src3")]
    docs = spark.createDataFrame([(*r, 1, "clash", "clash", 7, "clash", 3, "clash", "clash", 9) for r in rows], SCHEMA)
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def listed(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def plain_rules(rows):
    """No rule is learned from two labels, so the base rule alone decides."""
    out = []
    for r in rows:
        n_words, _, _, _, repeated = counts(r[1])
        if not (n_words < 50 or 100 * repeated > 50 * n_words):
            out.append(r)
    return out


def plain_classifier(rows, model):
    posterior, weights = model
    if len(posterior) < 2:
        return rows
    out = []
    for r in rows:
        at, by = quality_model.Hasher().features(r[1], quality_model.votes_and_freshness(r[1])[1])
        total = weights[-1] + sum(weights[int(i)] * float(x) for i, x in zip(at, by, strict=True))
        if 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))) < 0.5:
            out.append(r)
    return out


def check_near_duplicates(rows, got):
    component = brute_components([(r[0], r[1]) for r in rows], 80)
    assert Counter(r for r in got if r[0] is None) == Counter(r for r in rows if r[0] is None)
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(i for i, c in component.items() if i == c)
    assert set(got) <= set(rows)


def plain_domain(source):
    source = source or ""
    name = source.rstrip("0123456789")
    return name + "-" + (source[-1] if source[len(name) :] else "")


def plain_mixed(rows):
    leaf = lambda r: (plain_domain(r[3]), r[2] or "", r[3] or "")
    times = plain_mix([(r[0], leaf(r), len(WORDS.findall(r[1] or ""))) for r in rows], 0.5, 2, mixing.MIX)
    out = Counter()
    for (i, _), n in times.items():
        out[i] += n
    return out


def plain_pieces(rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return Counter((r[0], tuple(library.encode(r[1] or ""))) for r in rows)


def test_each_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = listed(docs)
    ruled = corpus_pipeline.quality_rule_stage(spark, docs, tables)
    assert tuple(ruled.columns) == corpus_pipeline.COLUMNS
    assert listed(ruled) == sorted(plain_rules(rows), key=repr)
    assert len(plain_rules(rows)) < len(rows)
    # Each stage on the odd documents themselves, so that what an earlier one rejects reaches it too.
    judged = corpus_pipeline.quality_model_stage(spark, docs, tables)
    want = plain_classifier(rows, quality_model.train(docs))
    assert listed(judged) == sorted(want, key=repr)
    assert 0 < len(want) < len(rows)
    left = corpus_pipeline.near_duplicate_stage(spark, docs, tables)
    assert tuple(left.columns) == corpus_pipeline.COLUMNS
    check_near_duplicates(rows, listed(left))
    mixed = corpus_pipeline.mixing_stage(spark, docs, tables)
    assert tuple(mixed.columns) == corpus_pipeline.COLUMNS
    assert Counter(r[0] for r in listed(mixed)) == plain_mixed(rows)
    encoded = corpus_pipeline.encoding_stage(spark, docs, tables).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == plain_pieces(rows)
    assert all(r["exact"] for r in encoded)


def test_the_whole_and_what_it_leaves_behind(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    judged = plain_classifier(ruled := plain_rules(listed(docs)), quality_model.train(spark.createDataFrame(ruled, docs.select(*corpus_pipeline.COLUMNS).schema)))
    component = brute_components([(r[0], r[1]) for r in judged], 80)
    left = {r[0]: r for r in judged if component.get(r[0]) == r[0]}
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, tables).collect())
    assert got
    # Which row of a repeated id stays is open; every other document is known.
    rows = [r for r in judged if r[0] is None] + list(left.values())
    mixed = plain_mixed(rows)
    known = {i: ids for (i, ids) in plain_pieces([r for r in rows if r[0] not in (None, 5)])}
    assert Counter({i: n for i, n in mixed.items()}) == Counter(i for (i, _), n in got.items() for _ in range(n)) or 5 in left
    assert all(ids == known[i] for i, ids in got if i in known)


def test_no_documents(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "mixing", "piece encoding"]
