"""Which parts of a frame to look at: moving boxes grouped, made squares, and squares that overlap brought together.

A frame's boxes are few, so each frame is a row with arrays and all of it is array expressions inside the JVM. Groups and
merged squares are fixpoints: an ordered fold takes what touches, grows, and looks again until nothing more touches. What
an expression uses more than once is bound by let(): lambdas are interpreted, and nothing finds their common parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, side_around, square_of
from .species import let

#: Boxes closer than this share of their size are one object; squares are padded by PADDING; they are merged if more than
#: OVERLAP of the smaller one is inside the other.
NEAR, PADDING, OVERLAP = 0.2, 0.2, 0.5

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
PIXELS = "struct<left:long,top:long,wide:long,high:long>"


def _box(c: Column) -> Box:
    return Box(c["x1"], c["y1"], c["x2"], c["y2"])


def _struct(b: Box) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (b.x1, b.y1, b.x2, b.y2), strict=True)))


def _union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def _times(n: Column) -> Column:
    """1 to n, or 1 for none."""
    return F.sequence(F.lit(1), F.greatest(n, F.lit(1)))


def cluster(boxes: Column) -> Column:
    """Bounding boxes of groups of boxes that touch once they are grown; a group grows with what it takes in, and takes in what it then touches."""

    grown = lambda b: _struct(_box(b).expanded(NEAR))

    def absorb(s: Column) -> Column:
        near = lambda g: F.coalesce(_box(s["grown"]).touches(_box(g["grown"])), F.lit(False))
        over = F.struct(s["own"].alias("own"), s["grown"].alias("grown"), s["rest"].alias("rest"), F.lit(True).alias("over"))
        larger = lambda own: F.struct(own.alias("own"), grown(own).alias("grown"), F.filter(s["rest"], lambda g: ~near(g)).alias("rest"), F.lit(False).alias("over"))
        joined = lambda taken: let(F.aggregate(taken, s["own"], lambda own, g: _union(own, g["own"])), larger)
        return let(F.filter(s["rest"], near), lambda taken: F.when(F.size(taken) > 0, joined(taken)).otherwise(over))

    def take(groups: Column, b: Column) -> Column:
        # Each turn that changes anything takes in one group at least.
        start = F.struct(b["own"].alias("own"), b["grown"].alias("grown"), groups.alias("rest"), (F.size(groups) == 0).alias("over"))
        done = F.aggregate(_times(F.size(groups)), start, lambda s, _: F.when(s["over"], s).otherwise(absorb(s)))
        return let(done, lambda s: F.concat(s["rest"], F.array(F.struct(s["own"].alias("own"), s["grown"].alias("grown")))))

    each = F.transform(boxes, lambda b: F.struct(b.alias("own"), grown(b).alias("grown")))
    none = F.array().cast(f"array<struct<own:{BOX},grown:{BOX}>>")
    return F.transform(F.aggregate(each, none, take), lambda g: g["own"])


def _square(b: Column, width: int, height: int, size: int) -> Column:
    def placed(wanted: Column) -> Column:
        left, top, side = square_of(_box(b), wanted, width, height, size)
        whole = side.isNull()
        return F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"), F.when(whole, width).otherwise(side).cast("long").alias("wide"), F.when(whole, height).otherwise(side).cast("long").alias("high"))

    return let(side_around(_box(b), width, height, PADDING), placed)


def merge_overlapping(squares: Column, width: int, height: int, size: int) -> Column:
    """Squares of which one lies mostly in another brought together, the earlier one first: it grows and looks at all later ones again."""

    def overlap(a: Column, b: Column) -> Column:
        side = lambda at, long: F.greatest(F.least(a[at] + a[long], b[at] + b[long]) - F.greatest(a[at], b[at]), F.lit(0))
        return side("left", "wide") * side("top", "high") > OVERLAP * F.least(a["wide"] * a["high"], b["wide"] * b["high"])

    def together(a: Column, b: Column) -> Column:
        right, low = (F.greatest(a[at] + a[long], b[at] + b[long]) for at, long in (("left", "wide"), ("top", "high")))
        both = Box(F.least(a["left"], b["left"]) / width, F.least(a["top"], b["top"]) / height, right / width, low / height)
        # Their squares are padded already.
        inner = let(_struct(both), lambda c: _struct(_box(c).expanded(-PADDING / (1 + PADDING))))
        return let(inner, lambda c: _square(c, width, height, size))

    def look(s: Column, b: Column) -> Column:
        return F.when(overlap(s["own"], b), F.struct(together(s["own"], b).alias("own"), s["rest"].alias("rest"), F.lit(True).alias("grew"))).otherwise(F.struct(s["own"].alias("own"), F.concat(s["rest"], F.array(b)).alias("rest"), s["grew"].alias("grew")))

    none = F.array().cast(f"array<{PIXELS}>")

    def turn(s: Column) -> Column:
        first = F.struct(F.get(s["left"], F.lit(0)).alias("own"), none.alias("rest"), F.lit(False).alias("grew"))
        looked = F.aggregate(F.slice(s["left"], 2, F.greatest(F.size(s["left"]), F.lit(1))), first, look)
        again = lambda x: F.struct(s["done"].alias("done"), F.concat(F.array(x["own"]), x["rest"]).alias("left"))
        over = lambda x: F.struct(F.concat(s["done"], F.array(x["own"])).alias("done"), x["rest"].alias("left"))
        return F.when(F.size(s["left"]) > 0, let(looked, lambda x: F.when(x["grew"], again(x)).otherwise(over(x)))).otherwise(s)

    # Every turn either ends one square or takes in another.
    return F.aggregate(_times(F.size(squares) * 2), F.struct(none.alias("done"), squares.alias("left")), lambda s, _: turn(s))["done"]


def select_regions(frames: DataFrame, width: int, height: int, size: int, most: int, keep: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keep, place (from 1), left, top, wide, high in pixels: at most so many regions of each frame. frames: motion and due,
    arrays of boxes (null or empty for none); regions of motion come first, the largest first, then those of boxes that are
    due for a look without motion. A group too large for a square is looked at in the whole frame."""
    if not (width and height and most):
        return frames.select(*keep, F.lit(1).alias("place"), *(F.lit(0).cast("long").alias(c) for c in ("left", "top", "wide", "high"))).limit(0)
    boxes = lambda c: F.transform(F.coalesce(c, F.array().cast(f"array<{BOX}>")), lambda b: _struct(_box(b)))
    d = frames.select(*keep, boxes("motion").alias("__motion"), boxes("due").alias("__due")).withColumn("__groups", cluster(F.col("__motion")))
    by_size = F.array_sort(F.transform("__groups", lambda g, i: F.struct((-_box(g).area()).alias("order"), i.alias("i"), g.alias("box"))))
    d = d.withColumn("__all", F.concat(F.transform(by_size, lambda g: g["box"]), F.col("__due")))
    d = d.withColumn("__squares", F.transform("__all", lambda b: _square(b, width, height, size)))
    d = d.withColumn("__regions", merge_overlapping(F.col("__squares"), width, height, size))
    d = d.select(*keep, F.posexplode(F.slice("__regions", 1, most)).alias("__place", "r"))
    return d.select(*keep, (F.col("__place") + 1).alias("place"), "r.left", "r.top", "r.wide", "r.high")
