"""URL filters, license scans, quality rules, token counts: against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailmark.llm import license_scan, quality_rules, token_counts, url_filters

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = [None, "", " \t\n", "one", "a b a b a b a b", "x\nx\n\n y\nx", "MIT License mit license", "GNU General Public License", "the m\u0130t license", "apache\u212a license Apache-License", "# $ & é\u00a0é", "w " * 30_000, "general public mit license general public license"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[6], (None, "mit license", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


def license_base(text):
    words = LICENSE_WORDS.findall((text or "").translate(FOLD))
    places = [(i, label) for said, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(said.split())] == said.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})


def counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats(words)


def test_license_base_places(spark, sf_dir, odd):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = license_scan.scan(docs).select("n_words", "n_base", "first_word", "last_word", "base_labels").collect()
        want = [license_base(r["text"]) for r in docs.select("text").collect()]
        assert Counter(map(tuple, got)) == Counter(want)


def test_license_fuzzy_and_negative(spark):
    long = "Permission is hereby granted, free of any charge, to any person obtaining a copy"
    rows = license_scan.scan(spark.createDataFrame([(1, long), (2, "licensed under cc by nc 4.0"), (3, "free of charge is permission")], "doc_id long, text string"))
    assert {r["doc_id"]: r["labels"] for r in rows.collect()} == {1: "mit", 2: "cc-by-nc", 3: ""}
    assert all(0 <= r["score"] <= 1 for r in rows.collect())


def test_license_spans(spark):
    whole = max(license_scan.MORE, key=len)
    assert len(whole.split()) > 62
    texts = ["x creative commons attribution noncommercial y", f"a b {whole} c", f"{' '.join(whole.split()[:40])} or so {' '.join(whole.split()[41:])}", "gnu lesser general public license", "license mit license mit license", None, "q " * 200_000 + "mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("base", F.lit(2))
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert {i: r["labels"] for i, r in got.items()} == {0: "cc-by-nc", 1: "mit", 2: "mit", 3: "gpl,lgpl", 4: "mit", 5: "", 6: "mit"}
    spans = sorted((r["doc_id"], r["start"], r["end"], r["label"]) for r in license_scan.spans(docs).collect())
    assert (0, 1, 5, "cc-by-nc") in spans
    assert (1, 2, 2 + len(whole.split()), "mit") in spans
    assert (2, 0, 1 + len(whole.split()), "mit") in spans
    assert [s for s in spans if s[0] == 4] == [(4, 1, 3, "mit"), (4, 3, 5, "mit")]
    assert (6, 200_000, 200_002, "mit") in spans
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert license_scan.spans(docs.limit(0)).count() == 0


def test_quality_counts(spark, sf_dir, odd):
    for docs in (odd.drop("n_words"), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = quality_rules.measure(docs).select(*quality_rules.COUNTS).collect()
        assert Counter(map(tuple, got)) == Counter(counts(r["text"]) for r in docs.select("text").collect())


def test_quality_rules_are_learned_and_spare_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    docs = [(i, f"{clean} extra{i}" + (" ###" * 30 if i % 4 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    judged = quality_rules.judge(docs, labels, min_precision=0.8).collect()
    assert {r["doc_id"] for r in judged if not r["kept"]} == {i for i in range(240) if i % 4 == 0}
    nothing = quality_rules.judge(docs, labels.where("false")).collect()
    assert all(r["kept"] != r["base_failed"] for r in nothing)


def test_quality_rules_on_no_documents(spark, odd):
    assert quality_rules.judge(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_token_counts_against_a_plain_loop(spark, sf_dir, odd):
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    long = spark.createDataFrame([(1, "a" * 300_000), (2, "é" * 100_000), (3, "\n" * 100_000)], "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("n", F.lit(1))
    for docs in (odd, long, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        lengths = [len(encode(r["text"] or "")) for r in docs.select("text").collect()]
        answers = token_counts.context_table(token_counts.histogram(docs), (1, 77, 4096, 10**7))
        assert {r["length"] for r in answers.collect()} == {*lengths, 1, 77, 4096, 10**7}
        for r in answers.collect():
            limit = r["length"]
            assert r["n_docs"] == lengths.count(limit)
            assert r["docs_at_least"] == sum(x >= limit for x in lengths)
            assert r["tokens_within_limit"] == sum(min(x, limit) for x in lengths)
            assert r["total_tokens"] == sum(lengths)
        assert token_counts.quantile(answers, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.context_table(token_counts.histogram(odd.limit(0))).count() == 0


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path):
    fits = [r for r in url_filters.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_urls(spark, sf_dir):
    odd = [None, "", "no scheme", "HTTP://Example.ORG/es/1?x=/en/1", "a://b://c/d", "http://org", "http://org/", "http://x.com/fr/\n2#t", "http://notcom/fr/", "s://?q", "http://de.example.org/en/1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd)] + [(3, odd[3], "again")], "page_id long, url string, host string")
    for table in (pages, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        got = url_filters.judge(table).collect()
        want = Counter((r["page_id"], *(p := url_parts(r["url"])), url_rule(*p)) for r in table.collect())
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
        assert all(r["verdict"] == url_filters.RULES[r["rule"]] for r in got if r["rule"])
        assert {r["verdict"] for r in got} <= {"allow", "block"}
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_url_templates_block_what_looks_like_blocked_urls(spark):
    rows = [(i, f"http://a{i % 5}.com/de/{i}") for i in range(200)] + [(1000 + i, f"http://b.net/de/{i}") for i in range(50)] + [(2000 + i, f"http://b.net/fr/{i}") for i in range(50)] + [(3000 + i, f"http://a.com/fr/{i}") for i in range(200)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[1000 + i] == "block" and got[2000 + i] == "allow" for i in range(50))


def test_url_branches_of_slowly_rising_rates_are_not_one_branch(spark):
    rows = []
    for k in range(21):
        for i in range(200):
            # A branch's URLs, of which 5k % are listed as blocked.
            rows.append((k * 1000 + i, f"http://h.com/p/s{'abcdefghijklmnopqrstu'[k]}"))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("h.com"))
    cells = pages.select("host", F.array(F.lit("p"), F.substring_index("url", "/", -1)).alias("segments"), (F.col("page_id") % 1000 < 10 * F.floor(F.col("page_id") / 1000)).alias("bad"))
    counts = cells.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a"))
    leaves = url_filters.tree(counts, 0.01, 8).withColumn("p0", F.lit(0.5))
    got = {r["template"]: r["block_rate"] for r in url_filters.merged(leaves, 2.0, 4.0).collect()}
    assert len(got) == 21
    for k in range(21):
        assert abs(got[f"/p/s{'abcdefghijklmnopqrstu'[k]}"] - k / 20) < 0.1
    assert got["/p/st"] >= 0.9  # 95 % blocked


def test_url_branches_that_differ_far_down(spark):
    deep = "/a/b/c/d/e"
    rows = [(i, f"http://x.com/de{deep}/bad/{i}") for i in range(50)] + [(100 + i, f"http://x.com/fr{deep}/good/{i}") for i in range(50)]
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0]["template"] == f"/de{deep}/bad/<number>"
    same = [(i, f"http://x.com{deep}/{'bad' if i % 2 else 'good'}/{'u' * (i % 7 + 1)}") for i in range(400)]
    cells = spark.createDataFrame(same, "page_id long, url string").select(F.lit("x.com").alias("host"), F.filter(F.split(url_filters.parts(F.col("url"))[1], "/"), lambda s: s != "").alias("segments"), (F.col("page_id") % 2 == 1).alias("bad"))
    counts = cells.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("a"))
    rates = url_filters.merged(url_filters.tree(counts, 0.01, 8).withColumn("p0", F.lit(0.5)), 2.0, 4.0).collect()
    assert all((r["block_rate"] > 0.9) == ("/bad/" in r["template"]) for r in rates) and len(rates) == 14


def test_many_slugs_and_a_long_url_on_one_host(spark):
    slugs = spark.range(200_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://busy.net/"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("/edit")).alias("url"))
    long = spark.createDataFrame([(-1, "http://busy.net/" + "x/" * 100_000), (-2, None)], "page_id long, url string")
    got = url_filters.judge(slugs.union(long))
    assert {r["template"]: r["count"] for r in got.groupBy("template").count().collect()} == {"/*/edit": 200_000, "/*/*/**": 1, "/": 1}
