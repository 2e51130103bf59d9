"""Conversation structure repair: the cheapest edits that give a conversation the shape `(s?(ua)+)?`, by iterative-deepening A*.

Rows of a conversation become one letter each: its role's initial (s, u, a; x for any other), in capitals if its text is
truncated, or `-` if it's blank or a duplicate and has to go. The search walks over these letters with four states: nothing
kept yet, and the initial last kept. Edits are tried in ASCII order, D I K R, under a bound on the cost that rises to the least
cost that the last round left open, so the first path that is accepted is the cheapest and of these the ASCII-least. A
transposition table holds, for each place and state that failed, what is needed there at least; it stays over the rounds.

A conversation is cut where every cheapest repair is known to pass: in the middle of 14 clean rows that alternate between
user and assistant. Out of step, each half of these would cost 7 at least; to get in step costs 2 (a row is deleted) and to
leave it again 4 at most, so every cheapest repair keeps rows of both halves and all between. Pieces are searched side by
side; equal pieces are searched once a batch. So the search doesn't grow with a conversation's length, nor do its tasks but
for conversations without 14 clean rows in sequence, whose piece is a letter a row.

Texts go through one shuffle by conversation, which sorts them, and one after the search, in which they are hashed as they
stream by; no task holds a conversation's texts. One hash over a conversation has to read it in sequence in one task.

Cases: nulls count as one space, in the crc as in role and text, and null turns come first; a null conv_id is a conversation
of its own; rows of one turn are ordered by role and text; a row whose turn, role and text are those of an earlier one is a
duplicate; a role is only known by its initial, so that 'sys' or 'u2' are taken; roles with another initial, empty ones too,
have to be deleted or get a new role; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Clean alternating rows on either side of a cut, and rows after which a longer alternating stretch is cut again.
IN_STEP, STRETCH = 7, 64
#: What may follow: nothing kept yet (""), or the initial last kept.
_TAKES = {"": "su", "s": "u", "u": "a", "a": "u"}
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def _least(letters: str) -> list[int]:
    """For each place what the rest costs at least: rows that go or are truncated, all s but one, and disjoint pairs of neighbours that may not meet."""
    least, after, free, system = [0] * (len(letters) + 1), "", True, False
    for i in range(len(letters) - 1, -1, -1):
        x = letters[i]
        cost = 0
        if x == "-":
            cost = DELETE
        elif x.isupper():
            cost, after, free = min(DELETE, TRUNCATED), "", True
        else:
            if x == "x" or x == "s":
                cost, after, free = REROLE if x == "x" or system else 0, "", True
                system |= x == "s"
            elif after and free and after not in _TAKES[x]:
                cost, after, free = REROLE, x, False
            else:
                after, free = x, True
        least[i] = least[i + 1] + cost
    return least


@lru_cache(maxsize=50_000)
def search(letters: str, entry: str = "", leave: str = "") -> tuple[int, str]:
    """Cost and path from the state entry: each edit's letter, followed by the initial it leaves (`-` for a deleted row).

    leave: the state that the path has to end in; empty for any that ends a conversation. letters: see the module.
    """
    n, least = len(letters), _least(letters)
    needs: dict[tuple[int, str], int] = {}  # what a place and state need at least: the least estimate, or more where a search failed
    done = (leave,) if leave else ("", "a")

    def edits(i: int, state: str) -> Iterator[tuple[str, int, int, str, str]]:
        if i < n:
            yield "D", DELETE, i + 1, state, "-"
        yield "I", INSERT, i, _NEXT[state], _NEXT[state]
        if i < n and letters[i] != "-":
            role, cut = letters[i].lower(), TRUNCATED if letters[i].isupper() else 0
            if role in _TAKES[state]:
                yield "K", KEEP + cut, i + 1, role, role
            yield "R", REROLE + cut, i + 1, _NEXT[state], _NEXT[state]

    def need(i: int, state: str) -> int:
        return max(needs.get((i, state), 0), least[i])

    while True:
        bound = need(0, entry)
        # A frame: place, state, budget left, edits to try, the least that any tried edit needs, and the edit it was reached by.
        stack = [[0, entry, bound, edits(0, entry), None, ""]]
        while stack:
            i, state, budget, rest, open_cost, _ = frame = stack[-1]
            if i == n and state in done:
                return bound, "".join(f[5] for f in stack)
            for edit, cost, j, then, made in rest:
                wanted = cost + need(j, then)
                if wanted <= budget:
                    stack.append([j, then, budget - cost, edits(j, then), None, edit + made])
                    break
                open_cost = wanted if open_cost is None else min(open_cost, wanted)
                frame[4] = open_cost
            else:
                # All edits failed: whoever comes here again needs more than this budget.
                stack.pop()
                needs[i, state] = max(need(i, state), open_cost)
                if stack:
                    spent = stack[-1][2] - budget
                    stack[-1][4] = min(x for x in (stack[-1][4], spent + needs[i, state]) if x is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, with one in five rows damaged by the CRC of `conv_id:turn`."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("__kind") == 0).alias("gone"), F.when(F.col("__kind") == 3, 2).otherwise(1).alias("__times"))
    return rows.withColumn("__times", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times")


def letters(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) in order, with pos, fault, letter, illegal (with the row before) and piece; rows that are gone keep their conversation known.

    One shuffle: all windows are over conversations or parts of them, sorted in place.
    """
    of = ("conv_id", "gone")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    d = rows.repartition("conv_id").withColumn("copy", F.row_number().over(Window.partitionBy(*of, "role", "text").orderBy("turn")))
    fault = F.when(blank, "blank").when(F.col("copy") > 1, "duplicate").when(cut, "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    order = Window.partitionBy(*of).orderBy("turn", "role", "text", "copy")
    d = d.withColumn("fault", fault).withColumn("initial", initial).withColumn("letter", letter)
    d = d.withColumn("pos", F.row_number().over(order).cast("long"))
    before = lambda c: F.lag(c).over(order)
    two = F.concat(before("initial"), F.col("initial"))
    d = d.withColumn("illegal", F.coalesce(~two.isin("su", "ua", "au"), F.lit(False)))
    d = d.withColumn("step", F.coalesce(F.concat(before("letter"), F.col("letter")).isin("ua", "au"), F.lit(False)).cast("int"))
    # Row m ends a piece if the rows from m - 6 to m + 7 alternate.
    around = order.rowsBetween(2 - IN_STEP, IN_STEP)
    d = d.withColumn("middle", (F.sum("step").over(around) == 2 * IN_STEP - 1).cast("int"))
    ends = (F.col("middle") == 1) & ((F.coalesce(F.lag("middle").over(order), F.lit(0)) == 0) | (F.col("pos") % STRETCH == 0))
    d = d.withColumn("ends", ends.cast("int"))
    d = d.withColumn("piece", F.coalesce(F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.select("conv_id", "turn", "role", "text", "gone", "pos", "fault", "letter", "illegal", "ends", "piece")


def _searched(letters: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([search(*of) for of in zip(letters, entry, leave, strict=True)], columns=["cost", "path"])


def pieces(lettered: DataFrame) -> DataFrame:
    """conv_id, piece, first (pos), cost, path: the repair of each piece."""
    grouped = lettered.where("not gone").groupBy("conv_id", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda r: r["letter"]), "").alias("letters"),
        F.min("pos").alias("first"),
        (F.max("ends") == 1).alias("ends"),
    )
    # A cut lies within alternating clean rows: the state before a piece is the other letter than its first.
    entry = F.when(F.col("piece") == 0, "").when(F.substring("letters", 1, 1) == "u", "a").otherwise("u")
    leave = F.when(F.col("ends"), F.substring("letters", -1, 1)).otherwise("")
    found = grouped.withColumn("r", F.pandas_udf(_searched, "cost long, path string")("letters", entry, leave))
    return found.select("conv_id", "piece", "first", "r.cost", "r.path")


def repaired(lettered: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, pos, k, role, text: the repaired conversations, in order of pos (of the row that stood there) and k."""
    # A row's edits are those inserted before it and its own; what is inserted behind the last row stands at the pos after it.
    moves = found.select("conv_id", "first", F.posexplode(F.expr("regexp_extract_all(path, '(I.)*[DKR].|(I.)+$', 0)")).alias("row", "edits"))
    moves = moves.select("conv_id", (F.col("first") + F.col("row")).alias("pos"), F.posexplode(F.expr("regexp_extract_all(edits, '..', 0)")).alias("k", "edit"))
    moves = moves.where("edit not like 'D%'")
    rows = lettered.where("not gone").select(F.col("conv_id").alias("__conv"), F.col("pos").alias("__pos"), "role", "text")
    met = moves.join(rows, F.expr("conv_id <=> __conv and pos = __pos and edit not like 'I%'"), "left")
    said = F.when(F.col("edit").startswith("K"), F.col("role")).when(F.col("edit").endswith("u"), "user").otherwise("assistant")
    return met.select("conv_id", "pos", "k", said.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def hashes(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired rows: their lines are hashed as they stream by, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, kind = None, None, pa.int64()
        for batch in batches:
            ids, shas, kind = [], [], batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if own == (conv,):
                    digest.update(b"\n")
                else:
                    if own:
                        ids.append(own[0])
                        shas.append(digest.hexdigest())
                    own, digest = (conv,), hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas, pa.string())], ["conv_id", "repaired_sha256"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([own[0]], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k").select("conv_id", "role", "text")
    return rows.mapInArrow(run, rows.select("conv_id", F.lit("").alias("repaired_sha256")).schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, gone): faults, cost, audit, and the repaired text's hash."""
    lettered = stored(letters(rows), "repair-letters")
    found = stored(pieces(lettered), "repair-pieces")
    left = lambda c: F.when(~F.col("gone"), F.col(c))
    # Distinct turns are counted in two steps with partial sums, so that a long conversation isn't one task.
    turns = lettered.groupBy("conv_id", left("turn").alias("__turn")).agg(
        *(F.count_if(~F.col("gone") & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.count_if(~F.col("gone") & F.col("illegal")).alias("illegal"),
    )
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("__turn") - F.min("__turn") + 1 - F.count("__turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "path"))), lambda r: r["path"]), "")
    audits = found.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.regexp_replace(whole, "(.).", "$1").alias("audit"))
    empty = F.sha2(F.lit(""), 256)
    out = counts.alias("c").join(audits.alias("a"), F.expr("c.conv_id <=> a.conv_id"), "left")
    out = out.join(hashes(repaired(lettered, found)).alias("h"), F.expr("c.conv_id <=> h.conv_id"), "left")
    return out.select("c.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
