"""Pixels: limited-range BT.601 between YUV and RGB, in whole numbers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much redder than blue, or how bright, a warm pixel of a thermal palette is.
RED_OVER_BLUE, BRIGHT = 40, 200


def is_warm(y: Column, u: Column, v: Column) -> Column:
    return (v - u >= RED_OVER_BLUE) | (y >= BRIGHT)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue."""
    light, blue, red = 298 * (y - 16) + 128, u - 128, v - 128
    byte = lambda x: F.greatest(F.least(F.shiftright(x, 8), F.lit(255)), F.lit(0))
    return byte(light + 409 * red), byte(light - 100 * blue - 208 * red), byte(light + 516 * blue)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    part = lambda x, zero: F.shiftright(x + 128, 8) + zero
    return part(66 * r + 129 * g + 25 * b, 16), part(112 * b - 38 * r - 74 * g, 128), part(112 * r - 94 * g - 18 * b, 128)
