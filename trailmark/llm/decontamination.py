"""Benchmark decontamination: windows of benchmark items found in documents by a prefix-filtered join of word shingles.

A window is `length` consecutive words of an item, or all words of a shorter item; its shingles are its runs of five words (of
all its words, if it has fewer). The documents' shingles meet those of the benchmark once, over whole texts; what met is slim
and is all that later steps read. A window occurs in a document only if all its shingles do, so a prefix of one shingle is
necessary: the rarest one, by its number of places in all documents. Only documents with that shingle are candidates; its
place says where the window would begin, which has to lie within the document's bounds; then the shingles that together
hold all words of the window are looked up at their places. They are compared as words, not as hashes, so this is exact.

The benchmark's shingles are broadcast up to MOST_BROADCAST of them, counted first; beyond that both sides are shuffled by
shingle. Documents with the same windows share one list of items. DataFrame functions only.

Cases: a null or empty text has no words, no windows and no hits; very long texts are read whole; an item found more than once,
and items with one text, count by id; windows of items without id are hit but counted for no item; repeated rows of documents
give repeated results (rows are told apart by their place in the input, not by doc_id); without documents there are no rows,
and without a benchmark nothing is hit; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored
from .license_scan import WORD_GAP

WINDOW, SHINGLE = 10, 5
#: Shingles of a benchmark that go to every task, of some 100 bytes each.
MOST_BROADCAST = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, with A-Z lower-cased and no other letter; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), lambda w: w != "")


def item_windows(items: DataFrame, key: str = "item_id", length: int = WINDOW) -> DataFrame:
    """key and win (words joined by spaces): the windows of each item, once."""
    n = F.size("words")
    first = F.sequence(F.lit(1), F.greatest(n - length, F.lit(0)) + 1)
    d = items.select(key, words_of(F.col("text")).alias("words")).where(n > 0)
    return d.select(key, F.explode(F.transform(first, lambda i: F.array_join(F.slice("words", i, length), " "))).alias("win")).distinct()


def _shingles(words: Column, n: Column, size: int) -> Column:
    """(i, shingle): all runs of size words, i from 0."""
    last = n - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(words, i + 1, size), " ").alias("shingle")))).otherwise(F.array().cast("array<struct<i: int, shingle: string>>"))


def _window_shingles(windows: DataFrame) -> DataFrame:
    """win, size (words of the window), o (place in the window), shingle."""
    d = windows.select("win", F.split("win", " ").alias("words")).withColumn("size", F.size("words"))
    width = F.least(F.lit(SHINGLE), F.col("size"))
    parts = F.transform(F.sequence(F.lit(0), F.col("size") - width), lambda o: F.struct(o.alias("o"), F.array_join(F.slice("words", o + 1, width), " ").alias("shingle")))
    return d.select("win", "size", F.explode(parts).alias("p")).select("win", "size", "p.o", "p.shingle")


def seen_shingles(docs: DataFrame, shingles: DataFrame, sizes: list[int], keep: tuple[str, ...]) -> DataFrame:
    """row, keep, n_words, i, shingle: a row with i = -1 for each document, and one for each place of a known shingle.

    shingles: column shingle, distinct; sizes: the numbers of words that they have."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    own = F.array(F.struct(F.lit(-1).alias("i"), F.col("row").cast("string").alias("shingle")))  # its row number, so that these rows spread
    rows = rows.select("row", *keep, F.col("n_words").cast("long"), F.explode(F.concat(own, *(_shingles(F.col("words"), F.col("n_words"), k) for k in sizes))).alias("at"))
    rows = rows.select("row", *keep, "n_words", "at.i", "at.shingle")
    few = shingles.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    known = shingles.select(F.col("shingle").alias("known"))
    met = rows.join(F.broadcast(known) if few else known, (F.col("shingle") == F.col("known")) & (F.col("i") >= 0), "left")
    met = met.where("i = -1 or known is not null")
    return stored(met.select("row", *keep, "n_words", "i", F.col("known").alias("shingle")), "seen-shingles")


def occurrences(seen: DataFrame, parts: DataFrame) -> DataFrame:
    """row, win, start, size: the places of windows, from the places of shingles."""
    places = seen.where("i >= 0").select("row", "n_words", "i", "shingle")
    spread = places.groupBy("shingle").agg(F.count("*").alias("n_places"))
    # Windows with a shingle that no document has end here. The rarest shingle of each other one is its prefix.
    ranked = parts.join(spread, "shingle", "left")
    prefixes = ranked.groupBy("win", "size").agg(F.min(F.struct(F.coalesce("n_places", F.lit(0)).alias("n_places"), "shingle", "o")).alias("p"))
    prefixes = prefixes.where("p.n_places > 0").select("win", "size", "p.shingle", "p.o")
    found = places.join(prefixes, "shingle").withColumn("start", F.col("i") - F.col("o"))
    found = found.where("start >= 0 and start + size <= n_words").select("row", "win", "start", "size", "shingle", F.col("o").alias("prefix_at"))
    # The first and the last shingle hold all words of a window; the prefix itself needs no second look.
    width = F.least(F.lit(SHINGLE), F.col("size"))
    ends = parts.where((F.col("o") == 0) | (F.col("o") == F.col("size") - width)).groupBy("win").agg(F.collect_set(F.struct("o", "shingle")).alias("ends"))
    asked = found.join(ends, "win")
    asked = asked.withColumn("ends", F.filter("ends", lambda e: e["o"] != F.col("prefix_at")))
    asked = asked.select("row", "win", "start", "size", F.size("ends").alias("n"), F.explode_outer("ends").alias("e"))
    there = places.select("row", "i", "shingle")
    met = asked.join(there.select(F.col("row").alias("__row"), F.col("i").alias("__i"), F.col("shingle").alias("__shingle")), F.expr("row = __row and start + e.o = __i and e.shingle = __shingle"), "left")
    met = met.groupBy("row", "win", "start", "size", "n").agg(F.count("__i").alias("k"))
    return met.where("k = n").select("row", "win", "start", "size")


def decontaminate(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = "item_id", length: int = WINDOW) -> DataFrame:
    """keep, n_words, n_hit (words within windows), n_items, items_sha256 (of the sorted ids, comma-joined), contaminated; one row for each row of docs."""
    windows = stored(item_windows(items, key, length), "item-windows")
    parts = stored(_window_shingles(windows.select("win").distinct()), "window-shingles")
    sizes = [r[0] for r in parts.select(F.least(F.lit(SHINGLE), F.col("size"))).distinct().collect()]  # SHINGLE of them at most
    seen = seen_shingles(docs, parts.select("shingle").distinct(), sorted(sizes), keep)
    found = stored(occurrences(seen, parts), "windows-found")

    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    spans = found.groupBy("row", "start").agg(F.max("size").alias("size")).withColumn("upto", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "upto"))).alias("n_hit"))

    sets = found.groupBy("row").agg(F.array_sort(F.collect_set("win")).alias("wins"))
    sets = stored(sets.select("row", F.sha2(F.array_join("wins", "\n"), 256).alias("wins_key"), "wins"), "window-sets")
    # Any of a set's documents stands for it.
    one = sets.groupBy("wins_key").agg(F.first("wins").alias("wins")).select("wins_key", F.explode("wins").alias("win"))
    ids = windows.where(F.col(key).isNotNull()).select("win", F.col(key).cast("string").alias("__item"))
    listed = one.join(ids, "win").groupBy("wins_key").agg(F.array_sort(F.collect_set("__item")).alias("__items"))
    listed = listed.select("wins_key", F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"))

    own = seen.where("i = -1").select("row", *keep, "n_words")
    out = own.join(hits.join(sets.select("row", "wins_key"), "row").join(listed, "wins_key", "left"), "row", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
