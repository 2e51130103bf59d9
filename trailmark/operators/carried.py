"""Ordered computations over a key's whole history without one task for the key: slots side by side, and little carried over.

Rows are cut into slots of a key by their order (a day, say). What a slot does to a running value is told by one row:
its first and last values and a sum, or, for decayed averages, the two numbers of the affine map y -> a y + b that its rows
compose to. These rows are put in order and give each slot the value that it begins with.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType


def _of(rows: DataFrame, key: str, slots: DataFrame) -> DataFrame:
    """Each row with its slot's row (__key, __slot, ...)."""
    return rows.join(slots, rows[key].eqNullSafe(slots["__key"]) & rows["__slot"].eqNullSafe(slots["__of"])).drop("__key", "__of")


def sessions(rows: DataFrame, key: str, at: str, gap: str, slot: str = "day") -> DataFrame:
    """Runs of rows of a key no further apart than the gap: a longer pause starts another. key, run (from 1), its first and
    last time, n. Rows without a time are one run, the first, with the earliest ones after it as another."""
    d = rows.select(key, at).withColumn("__slot", F.date_trunc(slot, at))
    within = Window.partitionBy(key, "__slot").orderBy(at)
    before = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(F.col(key).alias("__key"), F.col("__slot").alias("__of")).agg(F.max(at).alias("__end"))
    d = _of(d, key, ends.select("__key", "__of", F.max("__end").over(before).alias("__carried")))
    # The rows of one time are alike, so the first of them is as good as any.
    last = F.coalesce(F.lag(at).over(within), F.when(F.row_number().over(within) == 1, F.col("__carried")))
    d = d.withColumn("__new", F.coalesce((F.col(at) > last + F.expr(f"interval {gap}")).cast("int"), F.lit(1)))
    counts = d.groupBy(F.col(key).alias("__key"), F.col("__slot").alias("__of")).agg(F.sum("__new").alias("__n"))
    d = _of(d, key, counts.select("__key", "__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier")))
    d = d.withColumn("run", F.col("__earlier") + F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "run").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("n"))


def unwrapped(rows: DataFrame, key: str, order: str, clock: str, slot: Column, bits: int = 32) -> DataFrame:
    """A clock of so many bits without its wraps: the first value, then the sum of signed differences. slot: the part of a
    key's history that a row is in; it must not fall as order rises."""
    d = rows.withColumn("__slot", slot)
    within = Window.partitionBy(key, "__slot").orderBy(order)
    before = Window.partitionBy("__key").orderBy("__of")
    ends = d.groupBy(F.col(key).alias("__key"), F.col("__slot").alias("__of")).agg(F.max_by(clock, order).alias("__last"))
    d = _of(d, key, ends.select("__key", "__of", F.lag("__last").over(before).alias("__carried")))
    half = 1 << (bits - 1)
    last = F.when(F.row_number().over(within) == 1, F.col("__carried")).otherwise(F.lag(clock).over(within))
    step = F.pmod(F.col(clock) - last + half, F.lit(1 << bits)) - half
    d = d.withColumn("__step", F.coalesce(step, F.col(clock)))
    sums = d.groupBy(F.col(key).alias("__key"), F.col("__slot").alias("__of")).agg(F.sum("__step").alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = _of(d.drop("__carried"), key, sums.select("__key", "__of", earlier.alias("__earlier")))
    upto = F.sum("__step").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("unwrapped", F.col("__earlier") + upto).drop("__slot", "__step", "__earlier")


def composed(rows: DataFrame, key: str, order: list[str], slot: Column, a: Column, b: Column, start: Column | float = 0.0) -> DataFrame:
    """rows with after: the running value of a key after each of its rows, where a row turns y into a y + b (null for either:
    y stays) and the first row of a key finds start. slot: as for unwrapped().

    Each slot composes its rows from the identity on; a second pass over one row a slot gives the values that slots begin
    with. Both walk in order with two numbers in hand.
    """
    stays = a.isNull() | b.isNull()
    d = rows.withColumn("__slot", slot).withColumn("__a", F.when(stays, 1.0).otherwise(a).cast("double")).withColumn("__b", F.when(stays, 0.0).otherwise(b).cast("double"))
    d = d.withColumn("__start", F.lit(start).cast("double") if isinstance(start, float) else start.cast("double"))
    prefixes = _walked(d, [key, "__slot"], order)
    last = F.struct(*order)
    totals = prefixes.groupBy(key, "__slot").agg(F.max_by("__a", last).alias("__a"), F.max_by("__b", last).alias("__b"), F.min_by("__start", last).alias("__start"))
    upto = _walked(totals, [key], ["__slot"]).withColumn("__before", F.struct("__a", "__b"))
    w = Window.partitionBy(key).orderBy("__slot")
    first = F.first("__start").over(w)
    slots = upto.select(F.col(key).alias("__key"), F.col("__slot").alias("__of"), F.coalesce(F.lag("__a").over(w) * first + F.lag("__b").over(w), first).alias("__in"))
    d = _of(prefixes, key, slots)
    return d.withColumn("after", F.col("__a") * F.col("__in") + F.col("__b")).drop("__slot", "__a", "__b", "__start", "__in")


def _walked(rows: DataFrame, of: list[str], order: list[str]) -> DataFrame:
    """rows with __a and __b of all rows up to each, composed in order within a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, x, y = None, 1.0, 0.0
        for part in batches:
            keys = list(zip(*(part[c].astype(object).where(part[c].notna(), None) for c in of), strict=True))
            up, add = [], []
            for k, a, b in zip(keys, part["__a"].tolist(), part["__b"].tolist(), strict=True):
                if k != group:
                    group, x, y = k, 1.0, 0.0
                x, y = a * x, a * y + b
                up.append(x)
                add.append(y)
            yield part.assign(__a=up, __b=add)

    return rows.repartition(*of).sortWithinPartitions(*of, *order).mapInPandas(run, rows.schema)


#: Intervals in a slot of throttled(): one in so many rows may be the first that is kept there.
SLOT = 64


def throttled(rows: DataFrame, key: str, every: float, share: float = 0.9, most: int | None = None) -> DataFrame:
    """Rows of a key (id, at in seconds) that come at least a share of the interval after the last row that was kept; most
    of a key at most, if given (as pictures of one event are limited). Rows without a time are left out."""
    kept = passed(rows, key, share * every, kept_only=True)
    return (kept if most is None else kept.where(F.col("__before") < most)).select(*rows.columns)


def passed(rows: DataFrame, key: str, after: float, kept_only: bool = False) -> DataFrame:
    """rows that have a time with __kept: whether a throttle keeps them, as throttled() says; __before: how many rows of the
    key it has kept before; __from: the time of the last of these, null for none.

    Which row of a slot is kept first hangs on the slots before, but only rows of its first interval, and the one after, can
    be it. So each slot tells for each of these where the rows kept from it on end and how many they are; one pass over
    these few rows a key finds the first one of each slot; and then all slots are walked side by side. Slots are many and
    small, so each is a few lists and only whole batches are tables.
    """
    slot = F.floor(F.col("at") / (SLOT * after)) if after > 0 else F.lit(0).cast("long")
    d = rows.where("at is not null").withColumn("__slot", slot)
    of_slot = f"`{key}` {d.schema[key].dataType.simpleString()}, __slot long"
    found_schema, first_schema = f"{of_slot}, __place long, at double, __last double, __n long", f"{of_slot}, __first long, __before long, __from double"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[pa.Array] = []
        group, at, columns = None, [], [[] for _ in range(6)]

        def tell() -> None:
            """The rows of the group that may be kept first."""
            n = len(at)
            last, kept, then = list(range(n)), [1] * n, n
            for i in range(n - 1, -1, -1):
                # The next row that is far enough away.
                while then - 1 > i and at[then - 1] - at[i] >= after:
                    then -= 1
                if then < n:
                    last[i], kept[i] = last[then], kept[then] + 1
            few = min(bisect_right(at, group[1] * SLOT * after + after) + 1, n)
            for column, values in zip(columns, ([group[0]] * few, [group[1]] * few, range(few), at[:few], [at[j] for j in last[:few]], kept[:few]), strict=True):
                column.extend(values)

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*of, pa.int64(), pa.float64(), pa.float64(), pa.int64()], strict=True)], names=[key, "__slot", "__place", "at", "__last", "__n"])
            for c in columns:
                c.clear()
            return out

        for part in batches:
            of = [part.schema.field(c).type for c in (key, "__slot")]
            for k, s, t in zip(*(part.column(c).to_pylist() for c in (key, "__slot", "at")), strict=True):
                if group is None or s != group[1] or k != group[0]:
                    if group is not None:
                        tell()
                    group, at = (k, s), []
                at.append(t)
            yield batch()
        if group is not None:
            tell()
            yield batch()

    found = d.select(key, "__slot", F.col("at").cast("double").alias("at"), "id").repartition(key, "__slot").sortWithinPartitions(key, "__slot", "at", "id").drop("id").mapInArrow(entries, found_schema)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slot_now, last, n, hit = None, None, None, 0, False
        for part in batches:
            columns: list[list] = [[] for _ in range(5)]
            for k, s, place, at, end, kept in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now is None or k != now[0]:
                    now, slot_now, last, n = (k,), None, None, 0
                if s != slot_now:
                    slot_now, hit = s, False
                    told = (n, last)
                # A slot's first row comes even if none is kept: the others belong to what was kept before.
                first = not hit and (last is None or at - last >= after)
                if first or place == 0:
                    for column, value in zip(columns, (k, s, place if first else None, *told), strict=True):
                        column.append(value)
                if first:
                    hit, last, n = True, end, n + kept
            of = [part.schema.field(c).type for c in (key, "__slot")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*of, pa.int64(), pa.int64(), pa.float64()], strict=True)], names=[key, "__slot", "__first", "__before", "__from"])

    firsts = found.repartition(key).sortWithinPartitions(key, "__slot", "__place").mapInArrow(chosen, first_schema)
    names = rows.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, begins, n, last = -1, None, 0, None
        for part in batches:
            own, kept, before, since = [], [], [], []
            for is_row, at, first, earlier, end in zip(*(part.column(c).to_pylist() for c in ("__row", "__at", "__first", "__before", "__from")), strict=True):
                own.append(is_row)
                if not is_row:  # a slot begins; of two such rows the one with a place counts
                    if place >= 0:
                        place, begins = -1, None
                    n, last, begins = earlier, end, begins if first is None else first
                    kept.append(False)
                    before.append(None)
                    since.append(None)
                    continue
                place += 1
                hit = begins is not None and (place == begins or (place > begins and at - last >= after))
                kept.append(hit)
                before.append(n)
                since.append(last)
                if hit:
                    n, last = n + 1, at
            told = [pa.array(kept, pa.bool_()), pa.array(before, pa.int64()), pa.array(since, pa.float64())]
            whole = pa.record_batch([*(part.column(c) for c in names), *told], names=[*names, "__kept", "__before", "__from"])
            yield whole.filter(told[0] if kept_only else pa.array(own, pa.bool_()))

    both = d.withColumn("__row", F.lit(True)).unionByName(firsts.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    schema = StructType([*rows.schema.fields, StructField("__kept", BooleanType()), StructField("__before", LongType()), StructField("__from", DoubleType())])
    both = both.withColumn("__at", F.col("at").cast("double"))
    return both.repartition(key, "__slot").sortWithinPartitions(key, "__slot", "__row", "__at", "id").mapInArrow(walk, schema)


def frame_durations(units: DataFrame, usual: float = 3000.0, weight: float = 0.05, longest: int = 45_000) -> DataFrame:
    """units (camera_id, seq, ts90) with duration and decode_time in ticks of 90 kHz: a live stream without gaps. A frame lasts
    the running average of the steps between timestamps, of which resets and pauses (steps under 1 or over longest) are left
    out; decode times are the sum of all durations before."""
    slot = F.floor(F.col("seq") / 4096)
    d = _lagged(units, slot)
    step = F.when(F.col("__step").between(1, longest), F.col("__step"))
    d = composed(d, "camera_id", ["seq"], slot, F.when(step.isNotNull(), F.lit(1 - weight)), weight * step, usual)
    d = d.withColumn("duration", F.least(F.greatest(F.floor(F.col("after") + 0.5), F.lit(1)), F.lit(longest)).cast("long"))
    return _running(d.drop("after", "__step"), "duration", "decode_time", slot)


def _lagged(units: DataFrame, slot: Column) -> DataFrame:
    """units with __step: the timestamp less the one before, over the borders of slots too."""
    d = units.withColumn("__slot", slot)
    within, before = Window.partitionBy("camera_id", "__slot").orderBy("seq"), Window.partitionBy("__key").orderBy("__of")
    ends = d.groupBy(F.col("camera_id").alias("__key"), F.col("__slot").alias("__of")).agg(F.max_by("ts90", "seq").alias("__last"))
    d = _of(d, "camera_id", ends.select("__key", "__of", F.lag("__last").over(before).alias("__carried")))
    last = F.when(F.row_number().over(within) == 1, F.col("__carried")).otherwise(F.lag("ts90").over(within))
    return d.withColumn("__step", F.col("ts90") - last).drop("__slot", "__carried")


def _running(units: DataFrame, value: str, name: str, slot: Column) -> DataFrame:
    """units with the sum of value over all units of the camera before."""
    d = units.withColumn("__slot", slot)
    sums = d.groupBy(F.col("camera_id").alias("__key"), F.col("__slot").alias("__of")).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    d = _of(d, "camera_id", sums.select("__key", "__of", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier")))
    before = Window.partitionBy("camera_id", "__slot").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(name, F.col("__earlier") + F.coalesce(F.sum(value).over(before), F.lit(0))).drop("__slot", "__earlier")


def decode_means(decoded: DataFrame, keep: float = 0.95) -> DataFrame:
    """decoded (camera_id, seq, key_frame, ms) from a camera's first key frame on, with mean_ms: the first decoding time, then
    keep of the mean before and the rest of the new time."""
    first = decoded.where("key_frame").groupBy(F.col("camera_id").alias("__camera")).agg(F.min("seq").alias("__first"), F.min_by("ms", "seq").alias("__ms"))
    d = decoded.join(F.broadcast(first) if first.count() <= 100_000 else first, F.col("camera_id").eqNullSafe(F.col("__camera")) & (F.col("seq") >= F.col("__first")))
    later = F.col("seq") > F.col("__first")
    d = composed(d, "camera_id", ["seq"], F.floor(F.col("seq") / 4096), F.when(later, F.lit(keep)), (1 - keep) * F.col("ms"), F.col("__ms"))
    return d.drop("__camera", "__first", "__ms").withColumnRenamed("after", "mean_ms")
