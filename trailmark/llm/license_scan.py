"""License scans: k-gram diagonals between documents and license phrases.

Every rolling pair of words of a document meets the phrases' pairs by hash. A pair at word i of the text and word j of a
phrase votes for the diagonal i - j. A diagonal with all of a phrase's pairs is a verbatim place of it. Diagonals that lie
close together are merged, so that a phrase with inserted or missing words still collects its votes; their words are then
verified as a span, in the order of the text: a pair counts where it comes later in the phrase than all that counted before.
A span that lies within the span of another phrase is left to that one, but for base phrases, whose labels always stay.

Phrases may be as long as a licence. Cases: a null or empty text has no words, no places, null first and last words and
score 0; very long texts count whole; repeated rows give repeated results (rows are told apart by their place in the input,
not by doc_id); of equal spans the first phrase's stays; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base phrases of the contract, then those of the method, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MORE = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "cc by nc 4 0": "cc-by-nc",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc nd 4 0": "cc-by-nc-nd",
    "dedicated to the public domain": "public-domain",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
}
#: The phrases' pairs go to all tasks.
MOST_PAIRS = 200_000
#: Phrases with fewer pairs than this need all of them: shorter ones differ from each other in one word.
LEAST_FUZZY = 8

WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Runs of letters and digits, with A-Z lower-cased. lower() differs from that only in letters beyond ASCII, which no phrase holds, but for U+0130 and U+212A."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike("[İK]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.filter(F.split(plain, WORD_GAP, -1), lambda w: w != "")


def _spans(docs: DataFrame, base: dict[str, str], more: dict[str, str], slack: int, coverage: float) -> DataFrame:
    """row, doc_id, n_words, and for each diagonal that got votes: phrase, base, label, size, whether it's a place (of a base
    phrase), share (of the phrase's pairs, verified), start and end of the span if its label is accepted, and whether
    another span holds it. A document without votes has one row without phrase."""
    spark = docs.sparkSession
    phrases = [(i, said.split(), label, i < len(base)) for i, (said, label) in enumerate([*base.items(), *more.items()])]
    rows_of = [(i, j, f"{w[j]} {w[j + 1]}", len(w) - 1, label, is_base) for i, w, label, is_base in phrases for j in range(len(w) - 1)]
    if len(rows_of) > MOST_PAIRS or any(len(words) < 2 for _, words, _, _ in phrases):
        raise ValueError(f"phrases of two words or more, with {MOST_PAIRS} pairs at most")
    pairs = spark.createDataFrame(rows_of, "phrase int, j int, pair string, size int, label string, base boolean")
    pairs = pairs.withColumn("h", F.xxhash64("pair"))  # bounded by MOST_PAIRS
    firsts = sorted({w for _, words, _, _ in phrases for w in words[:-1]})
    seconds = sorted({w for _, words, _, _ in phrases for w in words[1:]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", license_words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # All rolling pairs; those of which a word is in no phrase can't meet any and end here.
    rolling = F.transform("words", lambda w, i: F.when(w.isin(firsts), i))
    rolling = F.filter(rolling, lambda i: i.isNotNull())
    rolling = F.filter(rolling, lambda i: F.coalesce(F.get("words", i + 1).isin(seconds), F.lit(False)))
    rolling = F.transform(rolling, lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)).alias("seen")))
    rows = rows.select("row", "doc_id", "n_words", F.explode_outer(rolling).alias("at"))
    rows = rows.select("row", "doc_id", "n_words", "at.i", "at.seen", F.xxhash64("at.seen").alias("h"))
    met = rows.join(F.broadcast(pairs), "h", "left")
    exact = F.col("pair") == F.col("seen")  # against equal hashes of different pairs
    met = met.select("row", "doc_id", "n_words", *(F.when(exact, F.col(c)).alias(c) for c in ("phrase", "size", "label", "base", "i")), F.when(exact, F.col("i") - F.col("j")).alias("diagonal"))

    # From here on all is grouped by row, on one deal of slim rows.
    met = met.repartition("row")
    votes = met.groupBy("row", "doc_id", "n_words", "phrase", "diagonal").agg(F.collect_set("i").alias("at"), *(F.first(c).alias(c) for c in ("size", "label", "base")))
    near = Window.partitionBy("row", "phrase").orderBy("diagonal").rangeBetween(0, slack)
    pairs_of = F.transform("at", lambda i: F.struct(i.alias("i"), (i - F.col("diagonal")).alias("j")))
    votes = votes.withColumn("seen", F.sort_array(F.flatten(F.collect_list(pairs_of).over(near))))
    start = F.struct(F.lit(-1).alias("upto"), F.lit(0).alias("n"))
    in_order = F.aggregate("seen", start, lambda s, p: F.when(p["j"] > s["upto"], F.struct(p["j"].alias("upto"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    place = F.coalesce(F.col("base") & (F.size("at") == F.col("size")), F.lit(False))
    share = F.when(F.col("phrase").isNotNull(), in_order / F.col("size"))
    votes = votes.withColumn("place", place).withColumn("share", share)
    enough = F.when(F.col("size") >= LEAST_FUZZY, coverage).otherwise(1.0)
    accepted = F.when(F.col("base"), F.col("place")).otherwise(F.coalesce(F.col("share") >= enough, F.lit(False)))
    first, last = F.array_min("seen")["i"], F.array_max("seen")["i"]
    votes = votes.withColumn("start", F.when(accepted, F.when(F.col("base"), F.col("diagonal")).otherwise(first)))
    votes = votes.withColumn("end", F.when(accepted, F.when(F.col("base"), F.col("diagonal") + F.col("size") + 1).otherwise(last + 2)))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), "phrase").rowsBetween(Window.unboundedPreceding, -1)
    return votes.withColumn("within", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))).drop("at", "seen")


def spans(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = MORE, slack: int = 2, coverage: float = 0.75) -> DataFrame:
    """doc_id, label, start, end (words from 0, end excluded), share, base: the spans that give a document its labels."""
    found = _spans(docs, base, more, slack, coverage).where("start is not null and (base or not within)")
    return found.select("doc_id", "label", "start", "end", "share", "base")


def scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = MORE, slack: int = 2, coverage: float = 0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of docs.

    slack: diagonals that far apart, in words, vote together. coverage: the share of a phrase's pairs that its span needs for
    its label; base phrases need all pairs on one diagonal. score: the best share in the text.
    """
    found = _spans(docs, base, more, slack, coverage)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if("place").alias("n_base"),
        F.min(F.when(F.col("place"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("place"), F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("start").isNotNull() & (F.col("base") | ~F.col("within")), F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")
