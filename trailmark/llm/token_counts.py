"""Token counts: an exact histogram of encoded lengths, and what suffix sums of it answer for every context limit.

Documents are encoded in Arrow batches and only (length, documents) leaves the encoding tasks. Suffix sums are taken in
blocks of lengths: sums of blocks first, then within each block, so no task holds the whole histogram.

Limits that no document has as its length are answered as well: they join the histogram with no documents of their own.

Cases: null and empty texts have length 0; repeated rows count as often as they occur; an empty table gives no
rows but for limits asked for. Texts are encoded whole; special tokens' strings are ordinary text. Extra columns aren't read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 256
#: Context limits that the query answers besides the lengths that occur.
LIMITS = tuple(2**k for k in range(7, 21))
#: Fixed value: how the byte-level vocabulary's public encoder splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """length, n_docs: how many documents have each encoded length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, found = encoder(vocabulary).encode_ordinary, Counter()
        for batch in batches:
            found.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"length": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})

    return docs.select("text").mapInArrow(count, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_table(lengths: DataFrame, limits: Iterable[int] = ()) -> DataFrame:
    """For each length L that occurs and each of limits, as a context limit: documents of that length, of at least that length, of more; all
    tokens; tokens within the limit (every document cut at L); tokens lost to it; documents and tokens of at most L as shares."""
    if limits := sorted(set(limits)):
        asked = lengths.sparkSession.createDataFrame([(x, 0) for x in limits], "length long, n_docs long")
        lengths = lengths.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    cells = lengths.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("t"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("t").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.join(blocks, "block").select("length", "n_docs", "all_docs", "all_tokens", (F.col("d_later") + F.sum("n_docs").over(within)).alias("docs_from"), (F.col("t_later") + F.sum("t").over(within)).alias("tokens_from"))
    over = F.col("docs_from") - F.col("n_docs")
    cut = F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")
    return out.select(
        "length",
        "n_docs",
        F.col("docs_from").alias("docs_at_least"),
        over.alias("docs_longer"),
        F.col("all_tokens").alias("total_tokens"),
        cut.alias("tokens_within_limit"),
        (F.col("all_tokens") - cut).alias("tokens_lost"),
        F.when(F.col("all_docs") > 0, (F.col("all_docs") - over) / F.col("all_docs")).alias("docs_quantile"),
        F.when(F.col("all_tokens") > 0, cut / F.col("all_tokens")).alias("tokens_kept_share"),
    )


def quantile(answers: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share q of the documents doesn't exceed, from context_table()."""
    return answers.where(F.col("docs_quantile") >= q).agg(F.min("length").alias("length"))
