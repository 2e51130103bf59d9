"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. A trigram's vector binds its letters' vectors, the
first rotated by two places, the second by one. A document's vector is the sum over its trigrams, a language's prototype
the sum of its documents' vectors brought to length one. The language with the largest cosine wins, ties to the name that
sorts first.

Trigrams run over letters in lower case, with every run of other characters as one blank. Vectors are made in tasks from
code points, so no vocabulary is gathered; prototypes are (languages x DIMENSIONS) sums, whatever the corpus.

Cases: null texts and texts without a letter are "und" with score 0, as is every text if nothing could be learned; null
languages are not learned from; very long texts count whole; repeated rows count as often as they occur in learning and
give repeated results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
SEED = 20_240_101
UNKNOWN = "und"
#: More languages than this aren't sent to the tasks as one table.
MOST_LANGUAGES = 5_000
#: Documents that are counted together, and characters that they may have together.
TOGETHER, CHARACTERS = 256, 2_000_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """The trigrams as numbers of 63 bits; blanks have code 0, a trigram with a letter in it at least."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


@lru_cache(maxsize=100_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def bound(grams: np.ndarray) -> np.ndarray:
    """A row of DIMENSIONS for each trigram."""
    columns = [grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for column, turn in zip(columns, (2, 1, 0), strict=True):
        codes, at = np.unique(column, return_inverse=True)
        out *= np.roll(np.stack([letter_vector(int(c)) for c in codes]), turn, axis=1)[at]
    return out.astype(np.float32)


def vectors(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first, rows): the vectors of a few documents at a time; a document without letters has zeros."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < TOGETHER and (end == at or size + len(texts[end] or "") <= CHARACTERS):
            size += len(texts[end] or "")
            end += 1
        each = [trigrams(t) if t else np.empty(0, np.int64) for t in texts[at:end]]
        grams, where = np.unique(np.concatenate(each), return_inverse=True)
        rows = np.zeros((end - at, DIMENSIONS), np.float32)
        if len(grams):
            doc = np.repeat(np.arange(end - at), [len(x) for x in each])
            for lo in range(0, len(grams), 8192):  # in blocks of trigrams, so that texts in many scripts fit too
                hit = (where >= lo) & (where < lo + 8192)
                width = min(8192, len(grams) - lo)
                counts = np.bincount(doc[hit] * width + where[hit] - lo, minlength=(end - at) * width).reshape(end - at, width).astype(np.float32)
                rows += counts @ bound(grams[lo : lo + width])
        yield at, rows
        at = end


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros(rows.shape), where=norms > 0)


def learn(labelled: DataFrame) -> dict[str, list[float]]:
    """Prototypes by language from columns lang and text. Tasks give one sum for each language; sums are rounded to
    2**-20 and added as whole numbers, so the result doesn't depend on the order of tasks."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, rows in vectors(batch.column("text").to_pylist()):
                own = np.rint(unit(rows) * 2**20).astype(np.int64)
                names = np.array(langs[at : at + len(rows)], object)
                for lang in set(names):
                    sums[lang] = sums.get(lang, 0) + own[names == lang].sum(0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    sums = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(bundle, "lang string, v array<long>")
    each = sums.groupBy("lang").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"d{i}") for i in range(DIMENSIONS))).limit(MOST_LANGUAGES + 1).collect()
    if len(each) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r[0]: [float(x) for x in r[1:]] for r in each if any(r[1:])}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score: only text is read for the prediction."""
    names = sorted(prototypes)
    table = unit(np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIMENSIONS))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, rows in vectors(batch.column("__text").to_pylist()):
                empty = ~rows.any(1) | (not names)
                near = unit(rows) @ table.T if names else np.zeros((len(rows), 1))
                best = near.argmax(1)
                langs += [UNKNOWN if e else names[b] for e, b in zip(empty, best, strict=True)]
                scores += np.where(empty, 0.0, near.max(1).clip(0, 1)).tolist()
            columns = [batch.column(k) for k in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(compare, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from two thirds of the documents, by the CRC of their ids."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    prototypes = learn(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes, ("doc_id", "held_out"))
