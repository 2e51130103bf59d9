"""A detector's output tensors as boxes: three layouts read by index arithmetic, suppression within a class, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .joins import suppressed
from .species import let

#: The classes that are told, by their number in either set, with the detector's own name for them.
ANIMALS = {0: ("animal", "animal"), 1: ("person", "person"), 2: ("vehicle", "vehicle")}
COCO = {
    0: ("person", "person"),
    **{i: ("vehicle", name) for i, name in ((1, "bicycle"), (2, "car"), (3, "motorcycle"), (5, "bus"), (6, "train"), (7, "truck"), (8, "boat"))},
    **{i: ("animal", name) for i, name in enumerate(("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe"), 14)},
}
#: Layouts: candidates in rows with an objectness, attributes in rows, and boxes that are suppressed already.
ROWS, COLUMNS, BOXES = "rows", "columns", "boxes"


def map_class(index: Column, classes: dict[int, tuple[str, str]]) -> Column:
    """(label, raw_class) of a class's number; null for classes that aren't told."""
    out = F.lit(None).cast("struct<label:string,raw_class:string>")
    for i, (label, name) in classes.items():
        out = F.when(index == i, F.struct(F.lit(label).alias("label"), F.lit(name).alias("raw_class"))).otherwise(out)
    return out


def _best(n: Column, score: object) -> Column:
    """(class, score) of the highest of n scores, the first of equals."""
    lowest = F.lit(-3.4028234663852886e38)
    start = F.struct(F.lit(0).cast("long").alias("class"), lowest.alias("score"))
    step = lambda best, c: F.when(score(c) > best["score"], F.struct(c.alias("class"), score(c).alias("score"))).otherwise(best)
    return F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), start, step)


def candidates(tensors: DataFrame, size: float, threshold: float, keep: tuple[str, ...] = ("frame",)) -> DataFrame:
    """keep, layout, i (the candidate's place), class, score and box (0 to 1) of all candidates from the threshold on.

    tensors: keep, layout, shape, values. Shapes that a layout doesn't have stop the query. Values are read up to the end of
    the tensor; null and NaN scores reach no threshold.
    """
    dim = lambda i: F.get("shape", F.lit(i)).cast("long")
    three = (F.size("shape") == 3) & (dim(0) == 1)
    fits = F.when(F.col("layout") == ROWS, three & (dim(2) >= 6)).when(F.col("layout") == COLUMNS, three & (dim(1) >= 5)).when(F.col("layout") == BOXES, three & (dim(2) == 6))
    said = F.concat(F.lit("unexpected shape "), F.to_json("shape"), F.lit(" of layout "), F.coalesce("layout", F.lit("null")))
    t = tensors.select(*keep, "layout", "shape", "values", F.when(F.coalesce(fits, F.lit(False)), True).otherwise(F.raise_error(said).cast("boolean")).alias("ok")).where("ok")
    at = lambda i: F.get("values", i.cast("int")).cast("double")
    n = F.when(F.col("layout") == COLUMNS, dim(2)).when(F.col("layout") == ROWS, F.least(dim(1), F.floor(F.size("values") / dim(2)))).otherwise(F.floor(F.size("values") / 6))

    def centred(a: Column, b: Column, w: Column, h: Column) -> Box:
        return Box((a - w / 2) / size, (b - h / 2) / size, (a + w / 2) / size, (b + h / 2) / size).clamped()

    def made(best: Column, score: Column, box: Box) -> Column:
        return F.struct(best.alias("class"), score.alias("score"), *box.columns())

    def of_row(i: Column) -> Column:
        start = i * dim(2)
        best = _best(dim(2) - 5, lambda c: at(start + 5 + c))
        return let(best, lambda b: made(b["class"], at(start + 4) * b["score"], centred(*(at(start + k) for k in range(4)))))

    def of_column(i: Column) -> Column:
        best = _best(dim(1) - 4, lambda c: at((4 + c) * dim(2) + i))
        return let(best, lambda b: made(b["class"], b["score"], centred(*(at(k * dim(2) + i) for k in range(4)))))

    def of_box(i: Column) -> Column:
        box = Box(*(at(i * 6 + k) / size for k in range(4))).ordered().clamped()
        return made(F.greatest(at(i * 6 + 5), F.lit(0.0)).cast("long"), at(i * 6 + 4), box)

    places = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    found = F.when(F.col("layout") == ROWS, F.transform(places, of_row)).when(F.col("layout") == COLUMNS, F.transform(places, of_column)).otherwise(F.transform(places, of_box))
    d = t.select(*keep, "layout", F.posexplode(found).alias("i", "c")).select(*keep, "layout", "i", "c.*")
    return d.where((F.col("score") >= threshold) & ~F.isnan("score"))


def detected(tensors: DataFrame, size: float, threshold: float, classes: dict[int, tuple[str, str]], most: float = 0.45) -> DataFrame:
    """frame, layout, i, label, raw_class, score and box: candidates that no better one of their class overlaps by more than most
    (joins.suppressed), of classes that are told."""
    d = candidates(tensors, size, threshold).withColumn("__of", F.struct("frame", "layout"))
    boxes = d.select(F.col("__of").alias("frame"), F.col("i").alias("det"), F.col("class").alias("label"), "score", "x1", "y1", "x2", "y2")
    kept = suppressed(boxes, most).select(F.col("frame").alias("__of"), F.col("det").alias("i"))
    d = d.join(kept, ["__of", "i"]).withColumn("__told", map_class(F.col("class"), classes)).where("__told is not null")
    return d.select("frame", "layout", "i", "__told.label", "__told.raw_class", "score", "x1", "y1", "x2", "y2")
