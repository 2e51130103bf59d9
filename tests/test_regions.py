"""Regions of frames against a plain walk, and the cases that the rules are about."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from trailmark.operators import regions

W, H = 640, 360


def box(x1, y1, x2, y2):
    return (x1 / W, y1 / H, x2 / W, y2 / H)


def expand(b, share):
    dx, dy = (b[2] - b[0]) * share / 2, (b[3] - b[1]) * share / 2
    return (b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy)


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def touch(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def square(b, size):
    wanted = math.ceil(max((b[2] - b[0]) * W, (b[3] - b[1]) * H) * 1.2)
    if wanted > H:
        return (0, 0, W, H)
    side = min(max(wanted, size), H)
    at = lambda c, long: math.floor(min(max(c * long - side / 2, 0.0), long - side))
    return (at((b[0] + b[2]) / 2, W), at((b[1] + b[3]) / 2, H), side, side)


def walked(motion, due, size, most):
    groups = []
    for b in motion:
        while near := [g for g in groups if touch(expand(b, 0.2), expand(g, 0.2))]:
            for g in near:
                b = union(b, g)
                groups.remove(g)
        groups.append(b)
    groups.sort(key=lambda g: -(g[2] - g[0]) * (g[3] - g[1]))
    left, done = [square(b, size) for b in [*groups, *due]], []
    while left:
        own, rest, grew = left[0], [], False
        for b in left[1:]:
            wide = min(own[0] + own[2], b[0] + b[2]) - max(own[0], b[0])
            high = min(own[1] + own[3], b[1] + b[3]) - max(own[1], b[1])
            if max(wide, 0) * max(high, 0) > 0.5 * min(own[2] * own[3], b[2] * b[3]):
                both = (min(own[0], b[0]) / W, min(own[1], b[1]) / H, max(own[0] + own[2], b[0] + b[2]) / W, max(own[1] + own[3], b[1] + b[3]) / H)
                own, grew = square(expand(both, -0.2 / 1.2), size), True
            else:
                rest.append(b)
        left = [own, *rest] if grew else rest
        done += [] if grew else [own]
    return done[:most]


def selected(spark, frames, size, most):
    table = spark.createDataFrame([(i, m, d) for i, (m, d) in enumerate(frames)], f"frame long, motion array<{regions.BOX}>, due array<{regions.BOX}>")
    got = [[] for _ in frames]
    for r in regions.select_regions(table, W, H, size, most).orderBy("frame", "place").collect():
        assert r["place"] == len(got[r["frame"]]) + 1
        got[r["frame"]].append((r["left"], r["top"], r["wide"], r["high"]))
    return got


def inside(r, b):
    return r[0] <= b[0] * W + 1e-6 and r[1] <= b[1] * H + 1e-6 and r[0] + r[2] >= b[2] * W - 1e-6 and r[1] + r[3] >= b[3] * H - 1e-6


def test_what_regions_are_for(spark):
    near = [box(200, 100, 240, 140), box(244, 104, 280, 150)]
    far = [box(10, 10, 40, 40), box(600, 320, 630, 350)]
    frames = [
        ([box(300, 150, 340, 190)], None),
        (far, []),
        (near, None),
        ([box(620, 340, 640, 360)], None),
        ([box(20, 30, 600, 330)], None),
        ([box(100, 100, 120, 120), box(160, 110, 180, 130)], None),
        ([box(10, 10, 30, 30)], [box(560, 280, 600, 330)]),
        ([], None),
        (None, None),
    ]
    small, two, one, edge, huge, merged, due, none, null = selected(spark, frames, 256, 4)
    assert [r[2:] for r in small] == [(256, 256)] and inside(small[0], frames[0][0][0])
    assert len(two) == 2 and all(any(inside(r, b) for r in two) for b in far)
    assert len(one) == 1 and all(inside(one[0], b) for b in near)
    assert edge == [(384, 104, 256, 256)]
    assert huge == [(0, 0, W, H)]
    assert len(merged) == 1
    assert len(due) == 2 and inside(due[0], frames[6][0][0]) and inside(due[1], frames[6][1][0])
    assert none == null == []
    [medium] = selected(spark, [([box(100, 50, 350, 300)], None)], 256, 4)
    assert [r[2:] for r in medium] == [(300, 300)]
    [most] = selected(spark, [([box(100 * i, 10, 100 * i + 10, 20) for i in range(6)], None)], 64, 3)
    assert len(most) == 3
    assert regions.select_regions(spark.createDataFrame([(1, None, None)], f"frame long, motion array<{regions.BOX}>, due array<{regions.BOX}>"), W, H, 64, 0).isEmpty()


def test_regions_of_many_boxes_like_a_plain_walk(spark):
    rng = random.Random(7)

    def some(n):
        at = [(rng.randrange(600), rng.randrange(330), rng.randint(2, 120), rng.randint(2, 90)) for _ in range(n)]
        return [box(x, y, x + w, y + h) for x, y, w, h in at]

    frames = [(some(rng.choice([0, 1, 2, 3, 5, 9])), some(rng.choice([0, 0, 1, 2, 4]))) for _ in range(300)]
    for size, most in ((64, 3), (200, 9)):
        assert selected(spark, frames, size, most) == [walked(m, d, size, most) for m, d in frames]


def test_a_box_without_an_edge_takes_no_group_away(spark):
    """A box that can't be placed touches nothing; others stay, wherever it comes."""
    whole, odd = (0.1, 0.1, 0.2, 0.2), (None, 0.1, 0.2, 0.2)
    frames = spark.createDataFrame([(1, [whole, odd], []), (2, [odd, whole], []), (3, [whole], [])], f"frame long, motion array<{regions.BOX}>, due array<{regions.BOX}>")
    groups = {r["frame"]: r["g"] for r in frames.select("frame", regions.cluster(F.col("motion")).alias("g")).collect()}
    assert [sum(tuple(g) == whole for g in groups[i]) for i in (1, 2, 3)] == [1, 1, 1]


def test_expressions_of_regions_do_not_repeat_themselves(spark):
    """Lambdas are interpreted, so every repeated part is computed again: they were written out five times as long."""
    c = spark.range(1).select(F.array(F.struct(*(F.rand(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))).alias("b"))
    squares = F.transform("b", lambda b: regions._square(b, W, H, 96))
    plan = c.select(regions.merge_overlapping(squares, W, H, 96))._jdf.queryExecution().analyzed().toString()
    assert plan.count("greatest(") + plan.count("least(") < 300
