"""Boxes with edges between 0 and 1, as expressions over their four columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip((self.x1, self.y1, self.x2, self.y2), ("x1", "y1", "x2", "y2"), strict=True)]

    def ordered(self) -> Box:
        return Box(F.least(self.x1, self.x2), F.least(self.y1, self.y2), F.greatest(self.x1, self.x2), F.greatest(self.y1, self.y2))

    def width(self) -> Column:
        return F.greatest(self.x2 - self.x1, F.lit(0.0))

    def height(self) -> Column:
        return F.greatest(self.y2 - self.y1, F.lit(0.0))

    def area(self) -> Column:
        return self.width() * self.height()

    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def expanded(self, share: float) -> Box:
        """Grown about its centre by a share of its sides; shrunk for a negative share."""
        dx, dy = self.width() * share / 2, self.height() * share / 2
        return Box(self.x1 - dx, self.y1 - dy, self.x2 + dx, self.y2 + dy)

    def clamped(self) -> Box:
        return Box(*(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) for c in (self.x1, self.y1, self.x2, self.y2)))

    def intersection(self, other: Box) -> Column:
        return Box(F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1), F.least(self.x2, other.x2), F.least(self.y2, other.y2)).area()

    def iou(self, other: Box) -> Column:
        both = self.intersection(other)
        union = self.area() + other.area() - both
        return F.when(union > 0, both / union).otherwise(0.0)

    def touches(self, other: Box) -> Column:
        return (self.x1 <= other.x2) & (other.x1 <= self.x2) & (self.y1 <= other.y2) & (other.y1 <= self.y2)

    def pixels(self, width: int, height: int) -> tuple[Column, Column, Column, Column]:
        """Left, top, width and height in pixels: outward to whole ones, within the picture, one at least."""
        b = self.clamped()
        left = F.least(F.floor(b.x1 * width), F.lit(width - 1))
        top = F.least(F.floor(b.y1 * height), F.lit(height - 1))
        right = F.least(F.greatest(F.ceil(b.x2 * width), left + 1), F.lit(width))
        bottom = F.least(F.greatest(F.ceil(b.y2 * height), top + 1), F.lit(height))
        return left, top, right - left, bottom - top

    def moved_by(self, vx: Column, vy: Column, seconds: Column) -> Box:
        """Where it is after that time at that speed, two seconds ahead at most."""
        t = F.least(seconds, F.lit(2.0))
        return Box(self.x1 + vx * t, self.y1 + vy * t, self.x2 + vx * t, self.y2 + vy * t)

    def within_region(self, left: Column, top: Column, size: Column, width: int, height: int) -> Box:
        """A box relative to a square of pixels, relative to the picture."""
        return Box((left + self.x1 * size) / width, (top + self.y1 * size) / height, (left + self.x2 * size) / width, (top + self.y2 * size) / height)


def aligned(left: Column, top: Column, wide: Column, high: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A pixel rectangle within the picture, with even edges and two pixels at least, as chroma planes need it."""
    even = lambda c: c - c % 2
    x, y = even(F.least(left, F.lit(max(width - 2, 0)))), even(F.least(top, F.lit(max(height - 2, 0))))
    return x, y, F.greatest(even(F.least(wide, width - x)), F.lit(2)), F.greatest(even(F.least(high, height - y)), F.lit(2))


def of_pixels(left: Column, top: Column, wide: Column, high: Column, width: int, height: int) -> Box:
    return Box(left / width, top / height, (left + wide) / width, (top + high) / height)


def letterbox(width: int, height: int, size: int) -> tuple[float, float, float]:
    """Scale and offsets that fit a picture into a square of that size, centred."""
    scale = size / max(width, height)
    return scale, (size - width * scale) / 2, (size - height * scale) / 2


def to_letterbox(x: Column, y: Column, fit: tuple[float, float, float]) -> tuple[Column, Column]:
    return x * fit[0] + fit[1], y * fit[0] + fit[2]


def from_letterbox(x: Column, y: Column, fit: tuple[float, float, float]) -> tuple[Column, Column]:
    return (x - fit[1]) / fit[0], (y - fit[2]) / fit[0]


def square_around(box: Box, width: int, height: int, size: int, padding: float) -> tuple[Column, Column, Column]:
    """Left, top and side of a square of pixels about a padded box: the model's size at least, all of a picture it doesn't fit."""
    return square_of(box, side_around(box, width, height, padding), width, height, size)


def side_around(box: Box, width: int, height: int, padding: float) -> Column:
    """The side in pixels that a square about a padded box wants."""
    return F.ceil(F.greatest(box.width() * width, box.height() * height) * (1 + padding))


def square_of(box: Box, wanted: Column, width: int, height: int, size: int) -> tuple[Column, Column, Column]:
    """square_around() with the side that it wants, which is used many times."""
    short = min(width, height)
    side = F.least(F.greatest(wanted, F.lit(size)), F.lit(short))
    cx, cy = box.center()
    left = F.floor(F.least(F.greatest(cx * width - side / 2, F.lit(0.0)), width - side))
    top = F.floor(F.least(F.greatest(cy * height - side / 2, F.lit(0.0)), height - side))
    fits = wanted <= short
    return F.when(fits, left).otherwise(0), F.when(fits, top).otherwise(0), F.when(fits, side)


def has_moved(origin: Box, now: Box, least: float, border: float = 0.01, balanced: float = 0.3) -> Column:
    """Whether a box has really moved: both edges of an axis shifted one way by more than a share of the diagonal, or the
    box grew or shrank a lot on both sides alike in its shape. Edges at the picture's border tell nothing."""
    inside = lambda c: c.between(border, 1 - border)

    def shift(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
        d1, d2 = b1 - a1, b2 - a2
        return F.when(inside(a1) & inside(b1) & inside(a2) & inside(b2) & (d1 * d2 > 0), F.least(F.abs(d1), F.abs(d2))).otherwise(0.0)

    dx, dy = shift(origin.x1, origin.x2, now.x1, now.x2), shift(origin.y1, origin.y2, now.y1, now.y2)
    far = F.sqrt(dx * dx + dy * dy) > least * F.sqrt(origin.width() * origin.width() + origin.height() * origin.height())
    tiny = F.lit(1e-7)
    aspect = lambda b: F.greatest(b.width(), tiny) / F.greatest(b.height(), tiny)
    ratio = F.greatest(now.area(), tiny) / F.greatest(origin.area(), tiny)
    alike = F.abs(aspect(now) / aspect(origin) - 1) <= 0.25
    left, right = origin.x1 - now.x1, now.x2 - origin.x2
    seen = inside(origin.x1) & inside(now.x1) & inside(origin.x2) & inside(now.x2)
    even = F.least(F.abs(left), F.abs(right)) >= balanced * F.greatest(F.abs(left), F.abs(right))
    return far | (alike & ~ratio.between(0.55, 1.8) & seen & (left * right > 0) & even)


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if ay != by:
            at = (bx - ax) * (y - ay) / (by - ay) + ax
            crossings = crossings + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at)).cast("int")
    return crossings % 2 == 1


def tiles(width: int, height: int) -> list[tuple[int, int, int]]:
    """Squares (left, top, side) as large as the shorter side, evenly spread along the longer one so that they overlap."""
    side, long = min(width, height), max(width, height)
    n = -(-long // side)
    steps = [(long - side) * i // (n - 1) if n > 1 else 0 for i in range(n)]
    return [(s, 0, side) if width >= height else (0, s, side) for s in steps]
