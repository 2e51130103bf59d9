"""Decontamination, periodic runs and conversation repair: against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import decontamination, periodic_runs, queries, turn_repair

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAK_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NONE = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Decontamination


def leaks(docs, items, length=10):
    of = {}
    for item, text in items:
        w = LEAK_WORDS.findall((text or "").translate(FOLD))
        for i in range(max(1, len(w) - length + 1) if w else 0):
            of.setdefault(tuple(w[i : i + length]), set()).add(item)
    sizes = {len(x) for x in of}
    for doc, text in docs:
        w = LEAK_WORDS.findall((text or "").translate(FOLD))
        places = [(i, n) for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in of]
        hit = {i + k for i, n in places for k in range(n)}
        ids = sorted({str(x) for i, n in places for x in of[tuple(w[i : i + n])] if x is not None})
        yield doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)


def test_leaks_of_all_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op11_decontamination(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = list(leaks(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_leaks_odd(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    rng = random.Random(5)
    word = lambda: rng.choice("abc")
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 7, 9, 10, 11, 14]))) for i in range(12, 30)] + [(1, None), (2, ""), (3, "a " * 12), (None, "d e f g h"), (4, "Only. Here!"), (5, "only here"), (5, "d d d d d d"), (1000000, "only here"), (7, "É l m n o ÄP \u0130 K"), (8, "é l m n o")]
    docs = [(i, text(rng.choice([0, 2, 5, 9, 10, 11, 40, 200]))) for i in range(60)] + [(None, "x d e f g h x"), (900, None), (901, ""), (902, "only"), (903, "only, HERE"), (903, "only, HERE"), (904, "z" * 20 + " d" * 9_000), (905, "a " * 15), (906, "only hKere here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("row", F.lit(2)).withColumn("win", F.lit(3))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = decontamination.decontaminate(d, i)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(leaks(docs, items), key=key)
    none = decontamination.decontaminate(d, i.limit(0))
    assert none.count() == len(docs) and none.where("contaminated or n_items > 0 or n_hit > 0").isEmpty()
    assert decontamination.decontaminate(d.limit(0), i).isEmpty()


# Periodic runs


def brute_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plant(doc, words):
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def run_digest(doc, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_of_random_words():
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        w = []
        while rng.random() < 0.8:
            unit = [rng.choice("ab" if rng.random() < 0.7 else "abcdefgh") for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 30, 33, 70]))]
            w += (unit * rng.choice([1, 2, 3, 4, 9, 30]))[: rng.choice([10, 24, 90, 400])]
            if rng.random() < 0.2:
                w += w[-rng.choice([5, 40, 100]) :]
        texts.append(w)
    # Periods in which every seed comes more than once: two loops through one block, each twice.
    block = list("qwertyuiopasdfghjklzxcvbnm")
    texts += [(block + ["1"] + block + ["1"] + block + ["2"] + block + ["2"]) * 4, ["x"] * 5_000, [], ["x"], ["x"] * 24, ["x"] * 23, list("ab") * 12, list("abcdefghi") * 3, list("abcdefghi") * 2 + list("abcdefgh")]
    numbers: dict[str, int] = {}
    sizes = np.array([len(t) for t in texts])
    words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t])
    want = [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t)]
    assert periodic_runs.find_runs(words, sizes) == want
    assert len(want) > 300 and len({q for *_, q in want}) > 10
    small = periodic_runs.MOST_CELLS
    try:
        periodic_runs.MOST_CELLS = 50
        assert periodic_runs.find_runs(words[: sizes[:60].sum()], sizes[:60]) == [r for r in want if r[0] < 60]
    finally:
        periodic_runs.MOST_CELLS = small
    for least in (2, 7, 60):
        assert periodic_runs.find_runs(words, sizes, least) == [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t, least)]


def test_runs_of_all_documents(spark, sf_dir):
    got = queries.op12_periodic_runs(spark, sf_dir).collect()
    want = [run_digest(d, plant(d, WORDS.findall(t or ""))) for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > len(want) // 20


def test_runs_odd(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "MOST_WORDS", 50)
    texts = [None, "", " \t\n", "a", "  \x1c " * 30, "xé " * 30, "a\nb\tc " * 200 + "tail", "w " * 60_000, " ".join(map(str, range(3_000)))]
    rows = [(i * 7 + k, t) for i, t in enumerate(texts) for k in range(12)] + [(None, "y z " * 40), (3, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit(2))
    got = periodic_runs.digests(periodic_runs.collapse(periodic_runs.planted(docs))).collect()
    cache = {}
    want = []
    for d, t in rows:
        words = plant(d, WORDS.findall(t or ""))
        at = tuple(words)
        if at not in cache:
            cache[at] = run_digest(None, words)[1:] if len(words) < 10_000 else (1, 0, 60_000, 1, 60_000_000, sha("0,60000,1\n"), sha("w"))
        want.append((d, *cache[at]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert periodic_runs.collapse(docs.limit(0)).isEmpty()
    kept = periodic_runs.collapse(docs.where("doc_id is null"), least=10).first()
    assert (kept["collapsed"], kept["runs"][0].asDict()) == ("y z", {"start": 0, "length": 80, "period": 2})


# Conversation repair


def least_path(letters, entry="", leave=""):
    """Cost and edits by dynamic programming over whole strings."""
    takes, then = turn_repair._TAKES, turn_repair._NEXT
    best = None
    for i in range(len(letters), -1, -1):
        cur = {}
        for s in takes:
            ways = [(0, "")] if i == len(letters) and s in ((leave,) if leave else ("", "a")) else []
            if i < len(letters):
                ways.append((best[s][0] + 2, "D" + best[s][1]))
                x = letters[i]
                if x != "-":
                    role, more = x.lower(), 5 * x.isupper()
                    if role in takes[s]:
                        ways.append((best[role][0] + more, "K" + best[role][1]))
                    ways.append((best[then[s]][0] + more + 1, "R" + best[then[s]][1]))
            cur[s] = min(ways, default=(10**9, ""))
        for _ in range(3):
            cur = {s: min(cur[s], (cur[then[s]][0] + 5, "I" + cur[then[s]][1])) for s in takes}
        best = cur
    return best[entry]


def test_search_is_cheapest_and_ascii_least():
    rng = random.Random(11)
    for _ in range(4_000):
        letters = "".join(rng.choice(rng.choice(["suaxSUAX-", "uaua-", "ua", "uaUA", "suaU-"])) for _ in range(rng.randint(0, 14)))
        entry, leave = rng.choice(["", "s", "u", "a"]), rng.choice(["", "u", "a"])
        cost, path = turn_repair.search(letters, entry, leave)
        assert (cost, path[::2]) == least_path(letters, entry, leave), (letters, entry, leave)
    for letters in ("u" * 900, "-" * 900, "UA" * 400, "s" * 500, "x" * 500, "uuaa" * 100, "ua" * 500):
        cost, path = turn_repair.search(letters)
        assert (cost, path[::2]) == least_path(letters)


def repaired(rows):
    """rows: (turn, role, text) of a conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    letters = "".join("-" if f in ("blank", "duplicate") else (x if x in ("s", "u", "a") else "x").upper() if f else (x if x in ("s", "u", "a") else "x") for f, x in zip(faults, initials, strict=True))
    cost, audit = least_path(letters)
    out, at = [], 0
    for edit in audit:
        role, text = (rows[at][1], rows[at][2]) if edit != "I" else ("", "")
        at += edit != "I"
        if edit in "RI":
            last = out[-1][0][0] if out else ""
            role = "assistant" if last == "u" else "user"
        if edit != "D":
            out.append((role, text))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))


def damage(rows):
    kept = {}
    for conv, turn, role, text in rows:
        own = kept.setdefault(conv, [])
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind:
            own += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    return kept


def held(got, rows):
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(got, key=str) == sorted(((c, *repaired(r)) for c, r in damage(rows).items()), key=str)


def test_repair_of_all_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    held(queries.op13_turn_repair(spark, sf_dir), rows)


def test_repair_odd(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "so", "", " \n", None, "done. \t", "what? ", "x" * 50_000 + "."]
    rows = [(c, rng.choice([None, 1, 1, 2, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "Uncle", "sys"]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(None, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(300)] + [(None, 7, "user", "7.")]
    # Long ones, which are cut in pieces: mostly clean, then never clean.
    rows += [(1_000 + c, t, ["user", "assistant"][t % 2], f"{t}{rng.choice('.!')}") for c in range(4) for t in range(rng.randint(200, 900))]
    rows += [(2_000, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"{t}.", f"{t}"])) for t in range(400)]
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:5".encode()) % 20 == 0 and c > 5_000)
    rows += [(gone, 5, "user", "All of it goes.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("copy", F.lit("x")).withColumn("piece", F.lit(None))
    held(turn_repair.repair(turn_repair.damaged(table)), rows)
    assert turn_repair.letters(turn_repair.damaged(table)).where("conv_id = 1000").agg(F.max("piece")).first()[0] >= 3
    assert turn_repair.repair(turn_repair.damaged(table.limit(0))).isEmpty()
