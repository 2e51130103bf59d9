"""Periodic runs: stretches of words that repeat with one period, found by seeds and extensions, and texts without the repeats.

A run of period q has q words that come at least three times, so at least max(least - q, 2 q) of its words equal the word
q further on. That is the overlap that seeds can count on: for periods from k to 2 k - 1 any run holds a k-gram that starts
at a multiple of k and comes again one period later. So the k-grams at multiples of k are looked up among the starts up to
2 k - 1 words on, in the same document, for k = least / 3 (which serves all shorter periods, too) and then for k doubled
again and again. That is two comparisons a word and size of k, whatever the text, and never all pairs of equal k-grams.

A pair of places at lag q is extended both ways by comparing words. For each lag a table holds how far the text is
covered; pairs before that are not extended again. Pairs that lie within one run of a shorter period are left out: what they
extend to has that shorter period. Equal k-grams are told by rolling hashes, runs by comparing words, so hashes lose and add
nothing.

Documents are scanned in place, many at a time: no shuffle, and memory grows with MOST_WORDS or the longest text.

Cases: a null text has no words, no runs and an empty collapsed text; an empty one likewise; very long texts are read whole;
where several runs hold a word, any of them drops it; of equal exponents the run that starts first and then the one with the
shorter period is the greatest; repeated rows give repeated results; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import space_words

LEAST = 24
EXPONENT = 3
#: Words, and places compared, that a task holds at a time beside its longest text.
MOST_WORDS, MOST_CELLS = 200_000, 2_000_000

RUNS = "array<struct<start: long, length: long, period: long>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 2**64))


def _equal_words(x: np.ndarray, y: np.ndarray) -> int:
    """The number of equal leading words of two views of one length, read in blocks that grow."""
    at, step = 0, 32
    while at < len(x):
        unlike = x[at : at + step] != y[at : at + step]
        if unlike.any():
            return at + int(unlike.argmax())
        at, step = at + step, 4 * step
    return len(x)


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs, sorted; words: numbers of the documents' words, one document after the other; sizes: their lengths."""
    ends_of = np.cumsum(sizes)
    starts_of = ends_of - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(len(words), np.int64)  # how far the run goes that begins before a place and ends last
    k = max(1, least // 3)
    mixed = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    hashes = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k if len(hashes) else 0):
        hashes += mixed[j : j + len(hashes)] * _power(j)
    low, longest = 1, int(sizes.max(initial=0))
    while EXPONENT * low <= longest and len(hashes):
        lags = np.arange(low, 2 * k)
        anchors = np.arange(0, len(hashes), k)
        left = ends_of[doc[anchors]] - anchors
        anchors = anchors[(left >= low + k) & (sizes[doc[anchors]] >= max(least, EXPONENT * low))]
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        # A block has as many anchors, or as many lags of one anchor, as MOST_CELLS allow.
        tall, wide = max(1, MOST_CELLS // len(lags)), min(len(lags), MOST_CELLS)
        for a in range(0, len(anchors), tall):
            at = anchors[a : a + tall, None]
            end, size = ends_of[doc[at]], sizes[doc[at]]
            for b in range(0, len(lags), wide):
                other = at + lags[None, b : b + wide]
                ok = (other + k <= end) & (other + k > reach[at]) & (EXPONENT * lags[None, b : b + wide] <= size)
                ok &= hashes[at] == hashes[np.minimum(other, len(hashes) - 1)]
                row, column = np.nonzero(ok)
                pairs.append((lags[b + column], at[row, 0]))
        if pairs:
            of, at = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            order = np.lexsort((at, of))
            of, at = of[order], at[order]
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                lag, places, p = int(of[lo]), at[lo:hi], 0
                while p < len(places):
                    i = int(places[p])
                    first, end = int(starts_of[doc[i]]), int(ends_of[doc[i]])
                    start = i - _equal_words(words[first:i][::-1], words[first + lag : i + lag][::-1])
                    covered = i + _equal_words(words[i : end - lag], words[i + lag : end])
                    if covered + lag - start >= max(least, EXPONENT * lag):
                        found.setdefault((start, covered + lag), lag)  # with a shorter period it has been found before
                    # Up to here this lag is covered; pairs within are not extended again.
                    p = int(np.searchsorted(places, max(covered, i + 1)))
        for start, end in found:
            reach[start] = max(reach[start], end)
        reach = np.maximum.accumulate(reach) if found else reach
        low = 2 * k
        if len(hashes) <= k:
            break
        hashes, k = hashes[:-k] + hashes[k:] * _power(k), 2 * k
    return sorted((int(doc[s]), s - int(starts_of[doc[s]]), e - s, q) for (s, e), q in found.items())


def _together(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of texts, as many texts at a time as have MOST_WORDS or make one."""
    some, n = [], 0
    for text in texts:
        some.append((text or b"").split())  # bytes are split at ASCII white space and nowhere else
        n += len(some[-1])
        if n >= MOST_WORDS:
            yield some
            some, n = [], 0
    if some:
        yield some


def collapse(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """keep, n_words, runs (words from 0, by start and period) and collapsed: the words that no run repeats, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _together(batch.column("__text").cast(pa.binary()).to_pylist()):
                numbers: dict[bytes, int] = {}
                sizes = np.array([len(t) for t in texts], np.int64)
                words = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
                found = find_runs(words, sizes, least)
                ends = np.cumsum(sizes)
                dropped = np.zeros(len(words) + 1, np.int64)
                for d, start, length, period in found:
                    first = int(ends[d] - sizes[d])
                    dropped[first + start + period] += 1
                    dropped[first + start + length] -= 1
                dropped = np.cumsum(dropped)
                hit = {d for d, *_ in found}
                kept = [b" ".join([w for w, gone in zip(t, dropped[ends[d] - sizes[d] :], strict=False) if not gone]) if d in hit else b" ".join(t) for d, t in enumerate(texts)]
                offsets = np.searchsorted([d for d, *_ in found], np.arange(len(texts) + 1))
                three = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(three, ["start", "length", "period"]))
                own = batch.slice(at, len(texts))
                columns = [own.column(c) for c in keep] + [pa.array(sizes), runs, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "runs", "collapsed"])
                at += len(texts)

    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic end in every tenth document by the CRC of its id; a null id leaves the text alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    d = docs.select("doc_id", "text", g.alias("__g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("__chosen"))
    d = d.withColumn("__words", F.when(F.col("__chosen"), space_words(F.col("text")))).withColumn("__n", F.size("__words").cast("long"))
    d = d.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    d = d.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    word = lambda i: F.get("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))
    places = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__n") - 1, F.lit(0)))
    repeated = F.array_join(F.transform(places, lambda i: F.when(i < F.col("__a"), F.get("__words", i.cast("int"))).otherwise(word(i))), " ")
    return d.select("doc_id", F.when(F.col("__chosen") & (F.col("__n") > 0), repeated).otherwise(F.col("text")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run with the most periods, by exact fractions; the first of equals."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(more(best, x), x).otherwise(best))


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, the greatest run and hashes of all runs and of the collapsed text."""
    d = collapsed.withColumn("best", greatest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
