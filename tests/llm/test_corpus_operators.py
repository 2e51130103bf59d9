"""Near-duplicates, pieces, mixing, classifier, neighbours, language: against brute force or held-out truth."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import components, language_id, mixing, near_duplicates, neighbours, pieces, quality_model

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shingle_set(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def near_rows():
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "a b c"), (7, "É x"), (8, "é x")]
    for i in range(10, 70):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"z{i}"
        rows.append((i, " ".join(own)))
    rows += [(12, rows[-1][1]), rows[-2], (90, "x " * 40_000), (91, "X\n" * 39_999)]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, docs, percent):
    odd = spark.createDataFrame([(i, t, "x") for i, t in near_rows()], "doc_id long, text string, sig string")
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
        want = brute_components(rows, percent)
        got = near_duplicates.resolve(table, percent).collect()
        assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingle_set(t))) for i, t in rows)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates.resolve(odd.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [near_duplicates.Limits(block_shingles=600), near_duplicates.Limits(block_bytes=3000), near_duplicates.Limits(dense=5, leaders=2, block_shingles=900, hot=3)])
def test_near_duplicates_under_small_limits(spark, limits):
    rows = near_rows()[9:69]
    got = near_duplicates.resolve(spark.createDataFrame(rows, "doc_id long, text string"), 80, limits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 80)


def test_linked_pairs_far_apart_in_a_block_too_large_for_a_task(spark, monkeypatch):
    limits = near_duplicates.Limits(block_shingles=200, hot=7)
    frame = type(spark.range(0))
    by_range = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *cols: by_range(self, 160, *cols))
    base = [f"w{i}" for i in range(120)]
    rows = []
    # Two places of ten: every text differs from the others in so much that only the two of a pair are linked.
    for i, places in enumerate(itertools.combinations(range(5, 55, 5), 2)):
        own = list(base)
        for at in places:
            own[at] = f"z{i}"
        rows.append((2 * i, " ".join(own)))
        for at in places:
            own[at + 55] = f"y{i}"
        own[-2:] = [f"x{i}"] * 2
        rows.append((2 * i + 1, " ".join(own)))
    want = brute_components(rows, 80)
    assert len(set(want.values())) == len(rows) // 2
    got = near_duplicates.resolve(spark.createDataFrame(rows, "doc_id long, text string"), 80, limits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_prefix_neighbours_over_the_borders_of_ranges(spark, ranges):
    rng = np.random.default_rng(ranges)
    sigs = rng.integers(0, 3, (300, near_duplicates.ROWS)).astype(np.uint16)
    classes = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "rep long, sig binary")
    lying = near_duplicates.orders(classes).repartitionByRange(ranges, "tree", "head", "deep", "rep").sortWithinPartitions("tree", "head", "deep", "rep")
    got = lying.mapInArrow(near_duplicates.prefix_neighbours, "tree int, head long, deep long, rep long").groupBy("tree", "head").agg(F.collect_list("rep").alias("reps")).where("size(reps) > 1").collect()
    want = defaultdict(set)
    for i, s in enumerate(sigs):
        for t in range(near_duplicates.TREES):
            want[t, s[t * near_duplicates.DEPTH : (t + 1) * near_duplicates.DEPTH].tobytes()].add(i)
    assert sorted((t, *sorted(r)) for (t, _), r in want.items() if len(r) > 1) == sorted((r["tree"], *sorted(r["reps"])) for r in got)


def test_neighbours_in_a_dense_region(spark, monkeypatch):
    limits = near_duplicates.Limits(dense=4)
    rng = np.random.default_rng(5)
    docs, feats = [], []
    # All share the first tree's prefix and little else; the two of a pair differ in one row of each tree, in the first one behind its prefix.
    for i in range(150):
        one = rng.integers(0, 2**16, near_duplicates.ROWS).astype(np.uint16)
        one[: near_duplicates.DEPTH] = 7
        other = one.copy()
        other[near_duplicates.DEPTH :: near_duplicates.DEPTH] += 1
        for k, sig in enumerate((one, other)):
            docs.append((2 * i + k, " ".join([f"w{i}_{j}" for j in range(60)] + [f"end{k}"])))
            feats.append((2 * i + k, 57, bytes([i, k]), sig.tobytes()))
    monkeypatch.setattr(near_duplicates, "features", lambda _: spark.createDataFrame(feats, "doc_id long, n_shingles long, set_key binary, sig binary").withColumn("n_bytes", F.lit(300).cast("long")))
    got = near_duplicates.resolve(spark.createDataFrame(docs, "doc_id long, text string"), 80, limits).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i, _ in docs}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


TEXTS = [None, "", " ", "\n", "  two  spaces\nnew line\n\n x", "a\tb", "ﬁ Å é 日本語テスト🙂", "<s>hi</s>", "▁x", "aaaa" * 500, "Hello world. Hello world!", "don't -- '▁}\r\n ok"]


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    model = pieces.load()
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    encoded = pieces.encode(table, model).cache()
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect() if r["doc_id"] != 0}
    for r in encoded.collect():
        if r["doc_id"] in texts:
            assert r["ids"] == library.encode(texts[r["doc_id"]])
            assert r["exact"] and r["n_tokens"] == len(r["ids"])
    for r in pieces.decode(encoded, model).collect():
        if r["doc_id"] in texts:
            assert r["decoded"] == texts[r["doc_id"]].replace("▁", " ")
    assert pieces.encode(table.limit(0), model).count() == 0


def test_pieces_in_small_chunks_and_dealt_buckets(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [*TEXTS, "x" * 200_000 + " é" * 70_000, " ".join(f"word{i}" for i in range(3000)), *TEXTS[5:8]]
    table = spark.createDataFrame([(i % 9, t, i, "clash", -i) for i, t in enumerate(texts)], "doc_id long, text string, n long, ids string, unit long")
    got = pieces.encode(table, pieces.load(), ("doc_id", "n"), pieces.Limits(chunk_units=40, chunk_places=500, bucket_entries=0.01)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["doc_id"] == r["n"] % 9
        assert r["ids"] == library.encode(texts[r["n"]] or "")
        assert r["exact"]


def test_models_that_are_not_supported_are_refused(tmp_path):
    text = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    number = lambda n, v: bytes([n << 3, v])
    piece = text(1, text(1, b"a") + number(3, 1))
    plain = text(3, number(4, 0))
    (tmp_path / "plain").write_bytes(piece + text(2, number(3, 2)) + plain)
    assert pieces.load(str(tmp_path / "plain")).kind == pieces.BPE
    for i, bad in enumerate((piece + text(3, number(4, 1)), piece + text(3, text(2, b"map") + number(4, 0)), text(1, text(1, b"u") + number(3, 4)) + plain)):
        (tmp_path / str(i)).write_bytes(bad)
        with pytest.raises(ValueError):
            pieces.load(str(tmp_path / str(i)))


def test_folds_agree_in_spark_and_python(spark):
    bpe = pieces.load()
    units = ["▁Hello", "▁the", "ation", "x", "▁▁▁▁", "▁internationalization", "-----", "aaaaaaa"]
    fold = lambda units, model: {r["unit"]: pieces.pieces_of(r["unit"], r["cuts"], model) for r in pieces.folded(pieces.lattice(spark.createDataFrame([(u,) for u in units], "unit string"), model), model).collect()}
    assert fold(units, bpe) == {u: pieces.merge(u, bpe) for u in units if u != "x"}
    toy = {"▁": -4.0, "a": -3.0, "b": -3.2, "ab": -4.5, "▁a": -5.0, "ba": -4.0, "aba": -8.0, "▁ab": -6.5}
    model = pieces.Model(pieces.UNIGRAM, {p: (s, i) for i, (p, s) in enumerate(toy.items())}, None, 99, [p.replace("▁", " ").encode() for p in toy])

    def best(text):
        if not text:
            return 0.0, []
        ways = [(toy[text[:n]] + best(text[n:])[0], [text[:n], *best(text[n:])[1]]) for n in range(1, len(text) + 1) if text[:n] in toy]
        return max(ways, key=lambda w: w[0])

    units = ["▁abab", "ba", "▁a", "abbaab", "b"]
    got = fold(units, model)
    for u in units:
        for ids in (got[u], pieces.best_path(u, model)):
            named = [list(toy)[i] for i in ids]
            assert "".join(named) == u
            assert abs(sum(toy[p] for p in named) - best(u)[0]) < 1e-9


def plain_shares(budget, nodes):
    """nodes: name -> (weight, most). Fills whoever can't use its share until all others can."""
    given, left = dict.fromkeys(nodes, 0), min(budget, sum(m for w, m in nodes.values() if w > 0))
    open_ = {k for k, (w, m) in nodes.items() if w > 0 and m > 0}
    while open_ and left:
        total = sum(nodes[k][0] for k in open_)
        full = {k for k in open_ if left * nodes[k][0] / total >= nodes[k][1]}
        if not full:
            want = {k: left * nodes[k][0] / total for k in open_}
            given |= {k: int(x) for k, x in want.items()}
            for k in sorted(open_, key=lambda k: (int(want[k]) - want[k], k))[: left - sum(given[k] for k in open_)]:
                given[k] += 1
            break
        for k in full:
            given[k] = nodes[k][1]
            left -= nodes[k][1]
        open_ -= full
    return given


def plain_budgets(budget, leaves, weights, epochs, path=()):
    """leaves: (domain, lang, source) -> tokens."""
    if len(path) == 3:
        return {path: budget}
    below = defaultdict(int)
    for leaf, n in leaves.items():
        if leaf[: len(path)] == path:
            below[leaf[len(path)]] += n * epochs
    out = {}
    for name, part in plain_shares(budget, {k: (weights.get(k, 1.0), m) for k, m in below.items()}).items():
        out |= plain_budgets(part, leaves, weights, epochs, (*path, name))
    return out


def plain_mix(rows, fraction, epochs, weights, seed=17):
    """rows: (doc_id, leaf, tokens). Which document comes in which epoch."""
    leaves = defaultdict(int)
    for _, leaf, n in rows:
        leaves[leaf] += n
    out = Counter()
    for leaf, part in plain_budgets(int(fraction * sum(leaves.values())), leaves, weights, epochs).items():
        if not part:
            continue
        whole, rest = divmod(part, leaves[leaf])
        own = [(i, n) for i, at, n in rows if at == leaf]
        out.update((i, e) for i, _ in own for e in range(whole))
        used = 0
        for i, n in sorted(own, key=lambda d: (hashlib.md5(f"{seed}:{'' if d[0] is None else d[0]}:{whole}".encode()).hexdigest()[:15], str(d[0]))):
            used += n
            if rest and used <= rest:
                out[i, whole] += 1
    return out


def test_budgets_fill_siblings_before_ancestors(spark):
    rows = [("a", "x", "1", 10), ("a", "y", "1", 200), ("b", "z", "1", 790)]
    leaves = spark.createDataFrame(rows, "__domain string, __lang string, __source string, n long")

    def parts(budget, weights):
        got = {(r["__domain"], r["__lang"]): r["part"] for r in mixing.budgets(leaves, budget / 1000, 1, weights).collect()}
        assert {(*k, "1"): v for k, v in got.items() if v} == {k: v for k, v in plain_budgets(budget, {r[:3]: r[3] for r in rows}, weights, 1).items() if v}
        return got

    assert parts(400, {"b": 3.0}) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 300}
    assert parts(1000, {}) == {("a", "x"): 10, ("a", "y"): 200, ("b", "z"): 790}
    assert not any(parts(0, {}).values())
    assert sum(parts(7, {}).values()) == 7
    assert parts(500, {"b": 0.0}) == {("a", "x"): 10, ("a", "y"): 200}


@pytest.mark.parametrize(("fraction", "epochs", "weights"), [(0.6, 2, {}), (0.5, 2, mixing.MIX), (1.3, 3, {"en": 10.0, "src3": 0.0}), (0.01, 1, {"de": 5.0})])
def test_mixing_selects_exactly_the_seeded_prefixes(spark, docs, fraction, epochs, weights):
    rows = [(r["doc_id"], (r["domain"], r["lang"] or "", r["source"] or ""), len(WORDS.findall(r["text"] or ""))) for r in docs.withColumn("domain", mixing.domain_of(F.col("source"))).collect()]
    got = mixing.select(docs, fraction=fraction, epochs=epochs, weights=weights).collect()
    assert Counter((r["doc_id"], r["epoch"]) for r in got) == plain_mix(rows, fraction, epochs, weights)


def test_mixing_edge_cases(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "s1", 0), (3, "a b c", "en", "s1", 5), (3, "a b c", "en", "s1", 5), (None, "d e", "en", "s2", 3), (7, "w " * 100_000, "en", "s3", 1), (8, "x y", "en", "s2", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain long")
    # Everything once: the leaf without tokens has no share, and the empty text goes with its leaf's whole epoch.
    assert Counter(r["doc_id"] for r in mixing.select(table, fraction=1.0, epochs=1).collect()) == {2: 1, 3: 2, None: 1, 7: 1, 8: 1}
    # Rows equal in id and text come together or not at all.
    for fraction in (0.00003, 0.00005, 0.0001):
        assert sum(r["doc_id"] == 3 for r in mixing.select(table, fraction=fraction, epochs=1, weights={"s-2": 0.0, "s-3": 0.0}).collect()) in (0, 2)
    assert mixing.select(table.limit(0)).count() == 0
    assert mixing.select(table, fraction=0.0).count() == 0


def test_classifier_on_held_out_labels(spark, sf_dir):
    base = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    table = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    rows = quality_model.judge(table).join(labels, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in rows)
    assert right / len(rows) > 0.93
    clean = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.98


def test_classifier_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "word " * 20), (3, "### " * 5000), (3, "### " * 5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality_model.judge(table).count() == 5
    assert quality_model.judge(table.limit(0)).count() == 0
    assert all(r["kept"] for r in quality_model.judge(spark.createDataFrame([(1, "same words here")] * 3, "doc_id long, text string")).collect())


def test_language_is_found_on_held_out_documents(spark, sf_dir):
    base = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    table = spark.read.parquet(f"{base}/documents.parquet")
    rows = language_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_language_vectors_against_a_plain_sum():
    text = "Ab, cé! ab"
    want = np.zeros(language_id.DIMENSIONS)
    padded = " ab cé ab "
    for i in range(len(padded) - 2):
        v = np.ones(language_id.DIMENSIONS)
        for k, c in enumerate(padded[i : i + 3]):
            v *= np.roll(language_id.letter_vector(0 if c == " " else ord(c)), 2 - k)
        want += v
    [(_, got)] = language_id.vectors([text])
    assert np.array_equal(got[0], want)


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "de"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "die katze", "de"), (6, "the cat", None), (7, "日本" * 5000, "ja")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(table).collect()
    assert len(got) == 8
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(table.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_nearest(vectors, k):
    out = {}
    for q, v in vectors.items():
        if q % 20 == 0:
            others = sorted(((-float(np.dot(v, w)), i) for i, w in vectors.items() if i != q))
            out[q] = others[:k]
    return out


@pytest.mark.parametrize("settings", [{}, {"leaf": 64}, {"leaf": 1000, "block_bytes": 40_000}])
def test_neighbours_recall(spark, sf_dir, settings):
    base = sf_dir.rsplit("/", 1)[0] + "/sf0.1"
    table = spark.read.parquet(f"{base}/embeddings.parquet")
    want = brute_nearest({r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}, 20)
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, **settings).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)


def test_neighbours_with_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, [0.0, 1.0]), (120, [1.0, -1.0]), (101, None), (102, []), (140, [0.0, 0.0]), (103, [1.0, None]), (104, [nan, 1.0]), (105, [inf, 1.0]), (None, [1.0, 1.0]), (106, [1.0, 2.0, 3.0]), (100, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 100, 120}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 20] == [i for i in range(21) if i != 20]
    few = neighbours.search(table.where("vec_id in (100, 120)"), F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in few} == {(100, 120, -1.0), (120, 100, -1.0)}
    assert neighbours.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_with_few_candidates_meet_all_vectors(spark):
    # Far more vectors than a leaf holds; a forest of one-sided trees has leaves with next to nothing in them.
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=3).astype(np.float32).astype(float) for i in range(400)}
    rows = [(i, v.tolist(), 1.0, "clash", 3, i) for i, v in vectors.items()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v double, cid string, n int, leaf long")
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k=150, leaf=4, trees=1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 20 and all(len(x) == 150 for x in got.values())
    all_of = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k=399, leaf=4, trees=1).orderBy("query_id", "rank").collect():
        all_of[r["query_id"]].append(r["vec_id"])
    assert {q: [i for _, i in w] for q, w in brute_nearest(vectors, 399).items()} == dict(all_of)


def test_expectation_maximisation_against_plain_loops():
    rng = random.Random(2)
    truth = [rng.random() < 0.3 for _ in range(600)]
    pattern = lambda bad: "".join(rng.choices([quality_model.GOOD, quality_model.BAD, quality_model.NONE], [1, 6, 3] if bad else [5, 0.02, 5])[0] for _ in quality_model.LABELLERS)
    docs = [pattern(bad) for bad in truth]
    got = quality_model.posteriors(dict(Counter(docs)), rounds=3)
    kinds = quality_model.GOOD + quality_model.BAD + quality_model.NONE
    p = [0.9 if d.count(quality_model.BAD) > 1 else 0.3 if quality_model.BAD in d else 0.01 for d in docs]
    for _ in range(3):
        prior = min(0.9, max(0.01, sum(p) / len(p)))
        rates = []
        for weigh in ([1 - x for x in p], p):
            of_class = []
            for k in range(len(quality_model.LABELLERS)):
                sums = {v: 0.5 + sum(w for w, d in zip(weigh, docs, strict=True) if d[k] == v) for v in kinds}
                rate = {v: x / sum(sums.values()) for v, x in sums.items()}
                held = min(rate[quality_model.BAD], quality_model.MOST_FALSE) if weigh is not p else max(rate[quality_model.BAD], quality_model.LEAST_TRUE)
                scale = (1 - held) / (1 - rate[quality_model.BAD])
                of_class.append({v: held if v == quality_model.BAD else x * scale for v, x in rate.items()})
            rates.append(of_class)
        p = []
        for d in docs:
            good, bad = 1 - prior, prior
            for k, v in enumerate(d):
                good, bad = good * rates[0][k][v], bad * rates[1][k][v]
            p.append(bad / (good + bad))
    for d, x in zip(docs, p, strict=True):
        assert abs(got[d] - x) < 1e-6
    assert sum((x > 0.5) == t for x, t in zip(p, truth, strict=True)) > 590


def test_prototypes_and_predictions_against_plain_sums(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog and the cat", "en"), (3, "die katze sitzt auf der matte", "de"), (4, "der hund und die katze", "de"), (5, None, "de"), (6, "12 34", "en"), (7, "the hund", None)]
    table = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    whole = {}
    for _, text, lang in rows:
        if text and lang:
            [(_, v)] = language_id.vectors([text])
            norm = np.sqrt((v[0].astype(float) ** 2).sum())
            if norm:
                whole[lang] = whole.get(lang, 0) + np.rint(v[0] / norm * 2**20)
    prototypes = language_id.learn(table)
    assert set(prototypes) == set(whole) and all(np.array_equal(np.array(prototypes[k]), whole[k]) for k in whole)
    for r in language_id.predict(table, prototypes).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        [(_, v)] = language_id.vectors([text])
        near = {k: float(v[0] @ w) / (np.linalg.norm(v[0].astype(float)) * np.linalg.norm(w)) for k, w in whole.items()}
        assert r["lang_pred"] == max(near, key=near.get) and abs(r["score"] - max(0, max(near.values()))) < 1e-9


def test_neighbours_rows_with_one_id_and_sample_over_all_of_the_table(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    twice = [(20, (-np.array(rows[20][1])).tolist()), (7, rng.normal(size=8).tolist())]
    table = spark.createDataFrame([*rows, *twice], "vec_id long, embedding array<float>")
    kept = {r["vec_id"]: r["v"] for r in neighbours.usable(table, "embedding").collect()}
    assert len(kept) == 300 and all(any(np.allclose(kept[i], v) for j, v in [*rows, *twice] if j == i) for i in kept)
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got}) == len({(r["query_id"], r["rank"]) for r in got}) == len(got) == 15 * 20
    # A sorted table whose first half is another cloud: trees fitted on its first rows would know nothing of the second.
    half = rng.normal(size=(2_000, 8)) + 40
    other = rng.normal(size=(2_000, 8)) - 40
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate((half, other)).astype(np.float32))], "vec_id long, embedding array<float>")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    hits = 0
    ids, points = np.array(list(vectors)), np.array(list(vectors.values()))
    found = {}
    for r in neighbours.search(table, F.col("vec_id") % 200 == 0, k=10, leaf=64, sample=500).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, near in found.items():
        best = [i for i in ids[np.argsort(-(points @ vectors[q]))] if i != q][:10]
        hits += len(near & set(best))
    assert hits >= 0.9 * 10 * 20
