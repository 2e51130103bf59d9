"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

Each labeller votes good, bad or abstains for every document. The corpus is reduced to counts of vote patterns, and
expectation-maximisation on those counts estimates how each labeller votes on either class (two classes, votes
independent given the class). The posteriors of a bounded sample of documents train a logistic scorer over hashed words
and word shapes, which then scores every document.

Cases: null and empty texts are scored like texts without words and get the vote pattern that such texts get; repeated
rows give repeated results; an empty table gives no rows; if all documents vote alike, nothing tells the classes apart and
all are kept. A probability of exactly 0.5 is rejected. Texts are read whole, however long. Extra columns are kept only where keep names them.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text

BUCKETS = 1 << 15
#: Characters of texts whose features are taken at once.
CHARACTERS = 500_000
#: The most documents that train the scorer; they are those with the smallest hashes of their id and text.
TRAIN_ROWS = 8_000
GOOD, BAD, NONE = "g", "b", "-"
LABELLERS = ("symbols", "prose", "plain_words", "shouting", "marks", "repetition", "vocabulary", "lines", "length")
#: A labeller calls at most this share of good documents bad, and at least this share of bad ones: it is better than chance.
MOST_FALSE, LEAST_TRUE = 0.01, 0.1
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
PLAIN = re.compile(rb"[\"'(]?[A-Za-z0-9\x80-\xff]+(?:['-][A-Za-z0-9\x80-\xff]+)*[.,;:!?\"')]{0,2}")
SHAPES = [(re.compile(r"[A-Z]+"), "X"), (re.compile(r"[a-zß-ɏ]+"), "x"), (re.compile(r"\d+"), "9")]


def vote(good: bool, bad: bool) -> str:
    return BAD if bad else GOOD if good else NONE


class PlainWords(dict):
    """Whether a word is a plain one; forgets all when full."""

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = PLAIN.fullmatch(word) is not None and not word.endswith(b"!!")
        return found


_plain = PlainWords()


def votes(text: str | None) -> str:
    """One letter for each of LABELLERS. Several look at each kind of fault, so that their votes overlap."""
    return votes_and_freshness(text)[0]


def votes_and_freshness(text: str | None) -> tuple[str, float]:
    """votes(), and the share of word triples that are the first of their kind."""
    raw = (text or "").encode("utf-8", "replace")
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, solid = max(1, len(words)), max(1, int(bins[33:].sum()))
    upper, lower = int(bins[65:91].sum()), int(bins[97:123].sum() + bins[128:].sum())
    prose = (upper + lower + int(bins[[39, 44, 45, 46, 58, 59]].sum())) / solid
    marks = (bins[33] + bins[63]) / n
    counts = Counter(words)
    plain = sum(k for w, k in counts.items() if _plain[w]) / n
    fresh = len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    said = "".join(
        (
            vote(False, bins[SYMBOLS].sum() > 0.03 * solid),
            vote(prose > 0.98, prose < 0.93),
            vote(plain > 0.95, plain < 0.75),
            vote(False, upper > 0.3 * (upper + lower) and upper > 10),
            vote(False, marks > 0.3),
            vote(fresh > 0.9, fresh < 0.6),
            vote(False, n >= 30 and n > 5 * len(counts)),
            vote(False, len(lines) > 2 and again > 0.25),
            vote(n >= 100, len(words) < 3),
        )
    )
    return said, fresh


def posteriors(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The probability that a document with a vote pattern is bad, by expectation-maximisation over patterns' counts."""
    patterns = sorted(counts)
    if len(patterns) < 2:
        return dict.fromkeys(patterns, 0.0)
    n = np.array([counts[p] for p in patterns], float)
    kinds = GOOD + BAD + NONE
    seen = np.array([[[c == k for k in kinds] for c in p] for p in patterns], float)  # pattern, labeller, vote
    bad = np.array([0.9 if p.count(BAD) > 1 else 0.3 if BAD in p else 0.01 for p in patterns])
    for _ in range(rounds):
        prior = min(0.9, max(0.01, float((n * bad).sum() / n.sum())))
        rates = []
        for w in (n * (1 - bad), n * bad):
            by_vote = np.einsum("p,plv->lv", w, seen) + 0.5
            rates.append(by_vote / by_vote.sum(1, keepdims=True))
        at = kinds.index(BAD)
        for rate, held in zip(rates, (rates[0][:, at].clip(max=MOST_FALSE), rates[1][:, at].clip(min=LEAST_TRUE)), strict=True):
            rate *= ((1 - held) / (1 - rate[:, at]))[:, None]
            rate[:, at] = held
        rates = [np.log(r) for r in rates]
        good_log = math.log(1 - prior) + np.einsum("plv,lv->p", seen, rates[0])
        bad_log = math.log(prior) + np.einsum("plv,lv->p", seen, rates[1])
        now = 1 / (1 + np.exp(np.clip(good_log - bad_log, -50, 50)))
        if np.abs(now - bad).max() < 1e-9:
            break
        bad = now
    return dict(zip(patterns, bad.tolist(), strict=True))


_KINDS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "X" * 26 + "x" * 26 + "9" * 10)
_RUNS = re.compile(r"([Xx9])\1+")


def shape(word: str) -> str:
    """The kinds of characters in a word, in order: letters of either case, digits, and the others themselves."""
    if word.isascii():
        return _RUNS.sub(r"\1", word.translate(_KINDS))[:6]
    for pattern, kind in SHAPES:
        word = pattern.sub(kind, word)
    return word[:6]


class _Known(dict):
    """Numbers of words, in order of appearance, with the buckets of each word and of its shape."""

    def __init__(self) -> None:
        self.words, self.shapes, self.of_shape = array("q"), array("q"), {}

    def __missing__(self, word: str) -> int:
        self.words.append(xxhash.xxh3_64_intdigest(b"w" + word.lower().encode("utf-8", "replace")) % BUCKETS)
        kind = shape(word)
        bucket = self.of_shape.get(kind)
        if bucket is None:
            bucket = self.of_shape[kind] = xxhash.xxh3_64_intdigest(b"s" + kind.encode("utf-8", "replace")) % BUCKETS
        self.shapes.append(bucket)
        found = self[word] = len(self)
        return found


class Hasher:
    """Texts to shares of hashed words and shapes. Words are looked up once; the table of those seen is emptied when full."""

    def __init__(self) -> None:
        self.known = _Known()

    def batch(self, texts: list[str | None], extras: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts the text's number, buckets and their values, by text: counts of words and shapes over the square root of
        the sum of their squares, and the share of fresh triples (extras)."""
        if len(self.known) > 200_000:
            self.known = _Known()
        words = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        start = np.repeat(np.arange(len(texts)) * BUCKETS, sizes)
        keys = np.concatenate((start + np.frombuffer(self.known.words, np.int64)[at], start + np.frombuffer(self.known.shapes, np.int64)[at])) if len(at) else at
        keys, counts = np.unique(keys, return_counts=True)
        doc = keys // BUCKETS
        norm = np.sqrt(np.bincount(doc, counts.astype(float) ** 2, len(texts)))
        by = counts / np.maximum(1.0, norm)[doc]
        # Buckets past the hashed ones: the share of fresh triples, in tenths, and the length as a power of two.
        tenths = BUCKETS + np.minimum(9, (np.array(extras) * 10).astype(np.int64))
        powers = BUCKETS + 10 + np.array([min(20, int(n).bit_length()) for n in sizes], np.int64)
        own = np.arange(len(texts))
        doc, at, by = np.concatenate((doc, own, own)), np.concatenate((keys % BUCKETS, tenths, powers)), np.concatenate((by, np.full(len(texts), 1.0), np.full(len(texts), 0.2)))
        order = np.argsort(doc, kind="stable")
        return doc[order], at[order], by[order]

    def features(self, text: str | None, extra: float) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of one text."""
        return self.batch([text], [extra])[1:]


def _together(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    """Texts, as many at a time as have some CHARACTERS or make one."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text or "")
        if n >= CHARACTERS or len(some) >= 1_000:
            yield some
            some, n = [], 0
    if some:
        yield some


WIDTH = BUCKETS + 32


def fit(each: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 120, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic scorer, by gradient steps over the features of the bounded sample."""
    doc = np.repeat(np.arange(len(each)), [len(a) for a, _ in each])
    at, by = np.concatenate([a for a, _ in each]), np.concatenate([b for _, b in each])
    weights, bias, square, square_bias = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-8), 1e-8
    # Either class weighs at most nine times the other.
    rare = min(9.0, max(1.0, float((1 - target).sum() / max(1.0, target.sum()))))
    weigh = target * rare + (1 - target)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, by * weights[at], len(each)) + bias, -30, 30)))
        error = weigh * (p - target) / weigh.sum()
        slope = np.bincount(at, by * error[doc], WIDTH) + decay * weights
        square, square_bias = square + slope**2, square_bias + error.sum() ** 2
        weights, bias = weights - rate * 0.1 * slope / np.sqrt(square), bias - rate * 0.1 * error.sum() / math.sqrt(square_bias)
    return np.append(weights, bias)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], list[float]]:
    """Posteriors by vote pattern, counted over all documents, and the scorer's weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            found.update(votes(t) for t in each_text(batch.column(0)))
        yield pa.RecordBatch.from_pydict({"votes": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    # At most 3 ** len(LABELLERS) rows, whatever the corpus.
    patterns = docs.select("text").mapInArrow(count, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    bad = posteriors({r["votes"]: r["n"] for r in patterns})
    total = sum(r["n"] for r in patterns)
    if not total:
        return bad, [0.0] * (WIDTH + 1)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            looks, each = [], []
            for texts in _together(each_text(batch.column("text"))):
                own = [votes_and_freshness(t) for t in texts]
                doc, at, by = hasher.batch(texts, [fresh for _, fresh in own])
                cuts = np.searchsorted(doc, np.arange(1, len(texts)))
                looks += own
                each += zip(np.split(at, cuts), np.split(by, cuts), strict=True)
            columns = [pa.array([a for a, _ in each], pa.list_(pa.int64())), pa.array([b for _, b in each], pa.list_(pa.float64())), pa.array([bad[v] for v, _ in looks], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("h"), *columns], ["h", "at", "value", "target"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, target = [], []
        for batch in batches:
            each += [(np.array(a, np.int64), np.array(b)) for a, b in zip(batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True)]
            target += batch.column("target").to_pylist()
        if each:
            yield pa.RecordBatch.from_pydict({"w": [fit(each, np.array(target)).tolist()]})

    hashed = F.xxhash64("doc_id", "text")
    # A little more than asked for passes the filter on hashes, the limit makes the bound strict.
    share = min(1.0, 1.2 * train_rows / total + 0.001)
    sample = docs.where(F.abs(hashed % 1_000_000) < int(share * 1_000_000)).select("text", hashed.alias("h"))
    # Texts are read where they lie; one task gets train_rows rows of at most WIDTH features, whatever their lengths.
    features = sample.mapInArrow(measured, "h long, at array<long>, value array<double>, target double").orderBy("h", "target").limit(train_rows)
    weights = features.repartition(1).sortWithinPartitions("h", "target").mapInArrow(learn, "w array<double>").collect()
    return bad, list(weights[0]["w"]) if weights else [0.0] * (WIDTH + 1)


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """keep, votes, weak_bad (the weak-label posterior), bad (the scorer's probability), kept."""
    posterior, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hasher = np.array(weights), Hasher()
        for batch in batches:
            said, p = [], []
            for texts in _together(each_text(batch.column("__text"))):
                own = [votes_and_freshness(t) for t in texts]
                doc, at, by = hasher.batch(texts, [fresh for _, fresh in own])
                said += [v for v, _ in own]
                p += (1 / (1 + np.exp(-np.clip(np.bincount(doc, w[at] * by, len(texts)) + w[-1], -30, 30)))).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(said, pa.string()), pa.array([posterior.get(v, 0.0) for v in said], pa.float64()), pa.array(p, pa.float64())], [*keep, "votes", "weak_bad", "bad"])

    schema = docs.select(*keep).schema.add("votes", "string").add("weak_bad", "double").add("bad", "double")
    split = len(posterior) > 1
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema).withColumn("kept", (F.col("bad") < threshold) if split else F.lit(True))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    return score(docs, train(docs, **options), keep)
