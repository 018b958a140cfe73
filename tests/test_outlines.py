"""Repair by the even-odd rule and outlines compared as point sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import shapes as sh
from tidegrid.functions import geometry as g
from tidegrid.operators.make_valid import even_odd_rings, make_valid
from tidegrid.operators.outlines import same_outlines

RINGS = "array<array<struct<x: double, y: double>>>"


def layer(spark, rows, key="id", geom="geometry"):
    raw = spark.createDataFrame(rows, f"{key} long, rings {RINGS}")
    return raw.select(key, g.make_polygon("rings", "false").alias(geom))


def repaired(spark, rows):
    fixed = make_valid(layer(spark, rows), "id")
    picked = fixed.select("id", "geometry.valid", F.size("geometry.rings").alias("n"), g.polygon_area("geometry").alias("area"))
    return {r.id: (r.valid, r.n, r.area) for r in picked.collect()}


def test_make_valid(spark):
    star = [(math.cos(4 * math.pi * i / 5) * 4, math.sin(4 * math.pi * i / 5) * 4) for i in range(5)]
    two_overlapping = [sh.UNIT[0], sh.moved(sh.UNIT, 2, 2)[0]]
    rows = [
        (1, sh.BOWTIE), (2, sh.HOLED), (3, sh.SPIKE), (4, sh.OPEN), (5, two_overlapping), (6, [[*star, star[0]]]),
        (7, [[(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)]]), (8, None), (9, sh.HOLE_ACROSS), (10, sh.BOWTIE),
        (11, [[(0.0, 0.0), (0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]]),
        (12, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]),  # a corner on another edge
    ]
    got = repaired(spark, rows)
    assert got[1] == got[10] == (True, 2, 8.0) and got[2] == (True, 2, 12.0) and got[4] == (True, 1, 16.0)
    assert got[3] == (True, 1, 16.0)  # the spike is gone
    assert got[5][0] and got[5][2] == 24.0  # the common part is out
    inner = (3 - math.sqrt(5)) / 2 * 4  # radius of the pentagon in the middle
    tips = 5 / 2 * (2 * inner * math.sin(math.pi / 5)) * (4 - inner * math.cos(math.pi / 5))
    assert got[6][0] and got[6][1] == 5 and got[6][2] == pytest.approx(tips, rel=1e-9)
    assert got[7][0] is False and got[8] == (None, None, None)
    assert got[9][0] and got[9][2] == pytest.approx(16 - 2 + 2)
    assert got[11] == (True, 1, 16.0)
    assert got[12][0] and got[12][2] == pytest.approx(8.0)


def brute_inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_random_outlines_keep_their_inside(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        ring = [(rng.randrange(64) / 4, rng.randrange(64) / 4) for _ in range(rng.randint(5, 14))]
        rows.append((i, [[*ring, ring[0]]]))
    fixed = {r.id: r for r in make_valid(layer(spark, rows), "id").collect()}
    assert sum(r.geometry.valid for r in fixed.values()) >= 11
    for i, rings in rows:
        new = [[(p.x, p.y) for p in ring] for ring in fixed[i].geometry.rings]
        for _ in range(200):
            x, y = rng.uniform(-1, 17), rng.uniform(-1, 17)
            assert brute_inside(rings, x, y) == brute_inside(new, x, y)


def test_nested_and_touching_rings():
    def segments(*rings):
        return np.array([(*p, *q) for ring in rings for p, q in zip(ring, ring[1:], strict=False)])

    outer, inner = sh.UNIT[0], sh.moved(sh.UNIT, 1, 1, 0.5)[0]
    rings = even_odd_rings(segments(outer, inner))
    turned = sorted(sum(x * v - u * y for (x, y), (u, v) in zip(r, r[1:], strict=False)) / 2 for r in rings)
    assert turned == [-4.0, 16.0]
    island = sh.moved(sh.UNIT, 1.5, 1.5, 0.25)[0]
    assert len(even_odd_rings(segments(outer, inner, island))) == 3
    assert even_odd_rings(segments(outer, outer)) == []
    corner = sh.moved(sh.UNIT, 4, 4)[0]  # two squares that touch in a point
    assert len(even_odd_rings(segments(outer, corner))) == 2


def test_same_outlines(spark):
    ell = sh.ELL[0][:-1]
    more = [p for a, b in zip(ell, ell[1:] + ell[:1], strict=True) for p in (a, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2))]
    rows = [
        (1, sh.ELL), (2, [[*ell[2:], *ell[:2], ell[2]]]), (3, [sh.ELL[0][::-1]]), (4, [[*more, more[0]]]), (5, sh.UNIT),
        (6, sh.HOLED), (7, [sh.HOLED[1], sh.HOLED[0]]), (8, sh.moved(sh.ELL, 1e-12, 0)), (9, None),
    ]
    a, b = layer(spark, rows, "a", "ga"), layer(spark, rows, "b", "gb")
    got = {(r.a, r.b) for r in same_outlines(a, b, "ga", "gb").select("a", "b").collect()}
    want = {(i, j) for group in ([1, 2, 3, 4], [5], [6, 7], [8]) for i in group for j in group}
    assert got == want
    with pytest.raises(ValueError):
        same_outlines(a, a, "ga", "ga")
