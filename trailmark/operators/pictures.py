"""Motion in small luma planes: a running background for each camera, the cells that changed, and their connected areas.

A camera's frames are judged by a background that each of them changes, so one camera is walked in order, in one task or one
key of a stream; only its background is held, whatever its history. What a frame shows leaves the walk as runs of cells
in rows, and areas are made of those by an ordered fold in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Settings:
    """threshold: brightness (0 to 255) by which a cell has to differ. area: share of the cells that an area needs.
    alpha: share that the background learns from a frame, a quarter of it where something moves. flash: share of changed cells
    beyond which the background starts anew. warm_up: frames before anything is told, again after a restart."""

    threshold: int = 25
    area: float = 0.002
    alpha: float = 0.02
    flash: float = 0.5
    warm_up: int = 10


#: Steps of the background in one step of brightness.
FINE = 16

RUNS = "camera_id string, frame long, width int, height int, changed_share double, runs array<struct<y:int,x1:int,x2:int>>"


def blurred(plane: np.ndarray) -> np.ndarray:
    """The mean of 3 x 3 cells, where edges count again; rounded."""
    p = np.pad(plane.astype(np.int64), 1, "edge")
    rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return (rows[:-2] + rows[1:-1] + rows[2:] + 4) // 9


def dilated(cells: np.ndarray) -> np.ndarray:
    """Every cell that is set or next to one that is."""
    p = np.pad(cells, 1)
    rows = p[:, :-2] | p[:, 1:-1] | p[:, 2:]
    return rows[:-2] | rows[1:-1] | rows[2:]


def downscaled(plane: np.ndarray, width: int) -> np.ndarray:
    """A plane of that width and a height in proportion, each cell the mean of the area it covers; never a larger one."""
    h, w = plane.shape
    if width >= w:
        return plane
    width = max(1, width)
    height = max(1, (h * width + w // 2) // w)

    def shares(n: int, m: int) -> np.ndarray:
        """How much of each of n cells lies in each of m."""
        edges = np.arange(m + 1) * n / m
        upto = np.clip(edges[:, None] - np.arange(n)[None, :], 0, 1)
        return (upto[1:] - upto[:-1]) * m / n

    return np.floor(shares(h, height) @ plane @ shares(w, width).T + 0.5).astype(np.int64)


def masked(polygons: list[list[tuple[float, float]]], width: int, height: int) -> np.ndarray:
    """Cells whose centre is inside a polygon (corners from 0 to 1), by the even-odd rule of each."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    out = np.zeros((height, width), bool)
    for polygon in polygons:
        inside = np.zeros_like(out)
        points = [(px * width, py * height) for px, py in polygon]
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        out |= inside if len(polygon) >= 3 else False
    return out


class Background:
    """What is known of one camera: the background times FINE (none before the first frame) and the frames seen."""

    def __init__(self, settings: Settings, polygons: list[list[tuple[float, float]]], seen: int = 0, ground: np.ndarray | None = None) -> None:
        self.s, self.polygons, self.seen, self.ground = settings, polygons, seen, ground
        self.mask = None if ground is None else masked(polygons, *ground.shape[::-1])

    def frame(self, plane: np.ndarray, warm: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """The share of changed cells, and the cells to show. warm: cells in which a change counts (of a thermal camera)."""
        h, w = plane.shape
        if self.ground is None or self.ground.shape != (h, w):
            self.ground, self.seen, self.mask = None, 0, masked(self.polygons, w, h)
        target, none = blurred(plane) * FINE, np.zeros((h, w), bool)
        self.seen += 1
        if self.ground is None:
            self.ground = target
            return 0.0, none
        changed = (np.abs(target - self.ground) > self.s.threshold * FINE) & ~self.mask
        share = float(changed.mean())
        if share > self.s.flash:
            self.ground, self.seen = target, self.s.warm_up
            return share, none
        grown = dilated(changed if warm is None else changed & warm)
        learn = min(256, max(1, int(np.floor(self.s.alpha * 256 + 0.5))))
        self.ground = self.ground + ((target - self.ground) * np.where(grown, max(1, learn // 4), learn) >> 8)
        return share, grown if self.seen > self.s.warm_up else none


def runs_of(cells: np.ndarray) -> list[tuple[int, int, int]]:
    """(y, x1, x2) of the runs of cells that are set, in order."""
    edges = np.diff(np.pad(cells.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x1 = np.nonzero(edges == 1)
    return list(zip(y.tolist(), x1.tolist(), (np.nonzero(edges == -1)[1] - 1).tolist(), strict=True))


def _walk(rows: pd.DataFrame, camera: Background) -> list[tuple]:
    out = []
    for r in rows.itertuples(index=False):
        shape = (r.height, r.width)
        warm = None if r.warm is None else np.asarray(r.warm, bool).reshape(shape)
        share, cells = camera.frame(np.asarray(r.luma, np.int64).reshape(shape), warm)
        out.append((r.camera_id, r.frame, r.width, r.height, share, runs_of(cells)))
    return out


def _told(out: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in RUNS.split(", ")]
    return pd.DataFrame([(*r[:5], [dict(zip(("y", "x1", "x2"), x, strict=True)) for x in r[5]]) for r in out], columns=names)


def _planes(planes: DataFrame) -> DataFrame:
    """Frames without a plane of width times height cells are left out."""
    warm = F.col("warm") if "warm" in planes.columns else F.lit(None).cast("array<boolean>")
    sound = F.coalesce((F.size("luma") == F.col("width") * F.col("height")) & (F.size("luma") > 0) & ~F.exists("luma", lambda x: x.isNull()), F.lit(False))
    return planes.where(sound).select("camera_id", "frame", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "luma", warm.alias("warm"))


def changes(planes: DataFrame, settings: Settings = Settings(), masks: dict[str, list] | None = None) -> DataFrame:  # noqa: B008
    """camera_id, frame, width, height, changed_share, runs: the cells of each frame that moved (grown by one cell), from
    planes (camera_id, frame, width, height, luma; warm: for thermal cameras). masks: polygons by camera in which nothing counts."""
    polygons = masks or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, camera = None, None
        for batch in batches:
            out = []
            for k, rows in batch.groupby("camera_id", sort=False, dropna=False):
                if camera is None or k != key:
                    key, camera = k, Background(settings, polygons.get(k, []))
                out += _walk(rows, camera)
            yield _told(out)

    return _planes(planes).repartition("camera_id").sortWithinPartitions("camera_id", "frame").mapInPandas(run, RUNS)


class ChangesProcessor(StatefulProcessor):
    """changes() for a stream: a camera's background and count of frames are the state of its key."""

    def __init__(self, settings: Settings, masks: dict[str, list]) -> None:
        self.settings, self.masks = settings, masks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ground", "seen int, width int, height int, ground array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        camera = Background(self.settings, self.masks.get(key[0], []))
        if self.state.exists():
            seen, width, height, ground = self.state.get()
            camera = Background(self.settings, self.masks.get(key[0], []), seen, np.asarray(ground, np.int64).reshape(height, width))
        out = _walk(pd.concat(list(rows)).sort_values("frame"), camera)
        h, w = camera.ground.shape
        self.state.update((camera.seen, w, h, camera.ground.ravel().tolist()))
        yield _told(out)

    def close(self) -> None:
        pass


def changes_stream(planes: DataFrame, settings: Settings = Settings(), masks: dict[str, list] | None = None) -> DataFrame:  # noqa: B008
    """The same for a stream whose frames come in order. The state lies in the RocksDB state store."""
    return _planes(planes).groupBy("camera_id").transformWithStateInPandas(ChangesProcessor(settings, masks or {}), RUNS, "Append", "none")


AREA = "struct<first:struct<y:int,x:int>,n:int,x1:int,y1:int,x2:int,y2:int,edge:array<struct<y:int,x1:int,x2:int>>>"


def areas(runs: Column) -> Column:
    """Connected areas (neighbours share an edge or a corner) of runs of cells in order of rows, as an array of structs: first
    cell, n cells, bounds, and the runs of its last two rows. Each run joins all areas that it meets in the row above."""

    def take(found: Column, r: Column) -> Column:
        meets = lambda a: F.exists(a["edge"], lambda e: (e["y"] == r["y"] - 1) & (e["x1"] <= r["x2"] + 1) & (r["x1"] <= e["x2"] + 1))
        own = F.struct(
            F.struct(r["y"].alias("y"), r["x1"].alias("x")).alias("first"), (r["x2"] - r["x1"] + 1).alias("n"), r["x1"].alias("x1"), r["y"].alias("y1"), r["x2"].alias("x2"), r["y"].alias("y2"), F.array(r).alias("edge")
        ).cast(AREA)

        def union(a: Column, b: Column) -> Column:
            edge = F.filter(F.concat(a["edge"], b["edge"]), lambda e: e["y"] >= r["y"] - 1)
            low, high = (lambda c: F.least(a[c], b[c]).alias(c)), (lambda c: F.greatest(a[c], b[c]).alias(c))
            return F.struct(low("first"), (a["n"] + b["n"]).alias("n"), low("x1"), low("y1"), high("x2"), high("y2"), edge.alias("edge"))

        return F.concat(F.filter(found, lambda a: ~meets(a)), F.array(F.aggregate(F.filter(found, meets), own, union)))

    return F.aggregate(runs, F.array().cast(f"array<{AREA}>"), take)


def motion_boxes(changed: DataFrame, least: float = Settings.area) -> DataFrame:
    """camera_id, frame, place (from 1), n cells, and the box of each area of changes() with that share of the cells or more, the
    largest first, of equals the one that begins first."""
    pixels = F.col("width") * F.col("height")
    d = changed.withColumn("__areas", F.filter(areas(F.col("runs")), lambda a: a["n"] >= F.floor(F.greatest(pixels * least, F.lit(1.0)))))
    d = d.withColumn("__areas", F.array_sort(F.transform("__areas", lambda a: F.struct((-a["n"]).alias("order"), a["first"].alias("first"), a.alias("a")))))
    d = d.select("camera_id", "frame", "width", "height", F.posexplode("__areas").alias("__place", "r"))
    edge = lambda c, more, of: ((F.col(f"r.a.{c}") + more) / F.col(of)).alias(c)
    return d.select("camera_id", "frame", (F.col("__place") + 1).alias("place"), F.col("r.a.n").alias("n"), edge("x1", 0, "width"), edge("y1", 0, "height"), edge("x2", 1, "width"), edge("y2", 1, "height"))
