"""Large polygons cut per cell and per slab, against the same question on whole rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests import shapes as sh
from tests.test_spatial_join import BRUTE, ids, left, points, right  # noqa: F401
from tidegrid.functions import geometry as g
from tidegrid.operators.cell_cover import cell_cover, point_in_cell_sql
from tidegrid.operators.slab_overlap import measured_pairs, slab_table
from tidegrid.operators.spatial_join import spatial_join


def wobbly(n, seed, cx=0.0, cy=0.0, radius=10.0, step=0.0):
    """A star-shaped ring of n corners, on a lattice of width ``step`` if that is given."""
    rng = random.Random(seed)
    ring = []
    for i in range(n):
        r = radius * (1 + 0.3 * math.sin(7 * 2 * math.pi * i / n) + 0.02 * rng.random())
        x, y = cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)
        ring.append((round(x / step) * step, round(y / step) * step) if step else (x, y))
    ring = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    return [*ring, ring[0]]


def layer(spark, rows, key="id", geom="geometry"):
    raw = spark.createDataFrame(rows, f"{key} long, rings array<array<struct<x: double, y: double>>>")
    return raw.select(key, g.make_polygon("rings", "true").alias(geom))


@pytest.mark.parametrize("edges, step", [(5, 0.0), (12, 0.25), (60, 1.0)])
def test_cells_answer_like_whole_outlines(spark, edges, step):
    hole = wobbly(60, 5, radius=4.0, step=step)[::-1]
    rows = [(0, [wobbly(300, 1, step=step), hole]), (1, [wobbly(200, 2, 9.0, -3.0, 5.0, step)]), (2, sh.ELL), (3, sh.HOLED)]
    shapes = layer(spark, rows, "__pid")
    rng = random.Random(6)
    where = [(rng.uniform(-15, 15), rng.uniform(-15, 15)) for _ in range(400)]
    where += [(rng.randrange(-60, 60) / 4, rng.randrange(-60, 60) / 4) for _ in range(600)]
    where += [tuple(p) for _, rings in rows for ring in rings for p in ring[::7]]
    spots = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(where)], "p int, x double, y double")
    cover = cell_cover(shapes, "geometry", edges).persist()
    assert cover.selectExpr("max(size(__edges))").first()[0] <= edges
    met = spots.join(cover, F.expr("floor(x / pow(2D, __lv)) = __cx AND floor(y / pow(2D, __lv)) = __cy"))
    assert met.groupBy("p", "__pid").count().where("count > 1").count() == 0
    whole = g.edges_sql("geometry.rings")
    tests = {"contains": g.contains_sql(whole, "x", "y"), "intersects": g.covers_sql(whole, "x", "y"), "touches": g.on_boundary_sql(whole, "x", "y")}
    for predicate, test in tests.items():
        got = ids(met.where(point_in_cell_sql(predicate, "x", "y")), "p", "__pid")
        assert got == ids(spots.crossJoin(shapes).where(test), "p", "__pid"), predicate
        assert got
    full = cover.where("size(__edges) = 0")
    assert (full.count() > 0 or edges > 50) and full.where("__w = 0").count() == 0
    cover.unpersist()


@pytest.mark.parametrize("cut_corners, block_rows", [(0, 20_000), (5, 3)])
def test_points_against_cut_polygons(left, points, cut_corners, block_rows):  # noqa: F811
    kw = {"cut_corners": cut_corners, "block_rows": block_rows}
    want = ids(left.crossJoin(points).where(g.contains_xy("a_geom", "lon", "lat")), "a_id", "p_id")
    assert ids(spatial_join(left, points, "contains", a_geom="a_geom", b_geom=("lon", "lat"), **kw), "a_id", "p_id") == want
    got = spatial_join(points, left, "within", a_geom=("lon", "lat"), b_geom="a_geom", **kw)
    assert got.columns == [*points.columns, *left.columns] and ids(got, "a_id", "p_id") == want
    assert spatial_join(left, points, "within", a_geom="a_geom", b_geom=("lon", "lat"), **kw).count() == 0
    hit = sorted({(p,) for _, p in want})
    kept = spatial_join(points, left, "within", "left_semi", a_geom=("lon", "lat"), b_geom="a_geom", **kw)
    assert ids(kept, "p_id") == hit
    rest = spatial_join(points, left, "within", "left_anti", a_geom=("lon", "lat"), b_geom="a_geom", **kw)
    assert ids(rest, "p_id") == sorted(set(ids(points, "p_id")) - set(hit))
    areas = spatial_join(left, points, "contains", "left_semi", a_geom="a_geom", b_geom=("lon", "lat"), left_key="a_id", **kw)
    assert ids(areas, "a_id") == sorted({(a,) for a, _ in want})
    part = spatial_join(
        points.withColumn("pp", F.col("p_id") % 2), left.withColumn("ap", F.col("a_id") % 2), "within",
        a_geom=("lon", "lat"), b_geom="a_geom", partition_keys=[("pp", "ap")], **kw,
    )
    assert ids(part, "a_id", "p_id") == [(a, p) for a, p in want if a % 2 == p % 2]


@pytest.mark.parametrize("predicate", list(BRUTE))
def test_cut_polygons(left, right, predicate):  # noqa: F811
    want = ids(left.crossJoin(right).where(BRUTE[predicate]("a_geom", "b_geom")), "a_id", "b_id")
    got = spatial_join(left, right, predicate, a_geom="a_geom", b_geom="b_geom", cut_corners=5)
    assert got.columns == [*left.columns, *right.columns] and ids(got, "a_id", "b_id") == want
    if predicate in ("intersects", "touches"):
        kept = spatial_join(left, right, predicate, "left_semi", a_geom="a_geom", b_geom="b_geom", left_key="a_id", cut_corners=0)
        assert ids(kept, "a_id") == sorted({(a,) for a, _ in want})


@pytest.mark.parametrize("edges", [7, 300])
def test_slabs_add_up_to_the_shared_area(spark, edges):
    a = layer(spark, [(0, [wobbly(300, 1)]), (1, [wobbly(150, 2, 4.0, 4.0, 6.0), wobbly(40, 3, 4.0, 4.0, 2.0)[::-1]]), (2, sh.moved(sh.HOLED, -1, -1))], "__pid")
    b = layer(spark, [(0, [wobbly(200, 4, 3.0, 1.0)]), (1, sh.moved(sh.ELL, 2, 2, 0.25)), (2, [wobbly(90, 5, 40.0, 0.0)])], "__pid")
    both = a.selectExpr("__pid AS __a", "geometry AS ga").crossJoin(b.selectExpr("__pid AS __b", "geometry AS gb"))
    both = both.where(g.boxes_meet_sql(g.Shape.of("ga"), g.Shape.of("gb")))
    want = {(r["__a"], r["__b"]): (r.shared, r.met) for r in both.select("__a", "__b", g.intersection_area("ga", "gb").alias("shared"), g.intersects("ga", "gb").alias("met")).collect()}
    rows = measured_pairs(both.select("__a", "__b"), a, b, "geometry", "geometry", edges).collect()
    got = {(r["__a"], r["__b"]): (r.shared, r.met) for r in rows}
    for pair, (shared, met) in want.items():
        assert got.get(pair, (0.0, False)) == (pytest.approx(shared, abs=1e-9), met), pair
    assert len(want) >= 6
    table = slab_table(a, "geometry", edges)
    assert table.selectExpr("max(size(__edges))").first()[0] <= max(2 * edges, edges + 12)


def test_overlap_column_of_cut_polygons(left, right):  # noqa: F811
    kw = {"a_geom": "a_geom", "b_geom": "b_geom", "overlap_area": "size_shared"}
    want = {(r.a_id, r.b_id): r.size_shared for r in spatial_join(left, right, "overlaps", **kw).collect()}
    got = {(r.a_id, r.b_id): r.size_shared for r in spatial_join(left, right, "overlaps", cut_corners=0, **kw).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_a_long_outline_is_spread(spark):
    """40,000 corners against 20,000 points: rows stay small and the points find their cells."""
    n = 40_000
    ring = wobbly(n, 9, radius=10.0)
    area = layer(spark, [(1, [ring])], "a")
    spots = spark.range(20_000).selectExpr("id", "rand(3) * 30 - 15 AS x", "rand(4) * 30 - 15 AS y").persist()
    cover = cell_cover(area.withColumnRenamed("a", "__pid"), "geometry")
    assert cover.selectExpr("max(size(__edges))").first()[0] <= 256
    assert cover.selectExpr("sum(size(__edges))").first()[0] < 2 * n
    inside = {r.id for r in spatial_join(spots, area, "within", a_geom=("x", "y"), b_geom="geometry").select("id").collect()}
    import numpy as np

    rows = np.array([(r.id, r.x, r.y) for r in spots.collect()])
    x, y = rows[:, 1][:, None], rows[:, 2][:, None]
    a, b = np.array(ring[:-1]), np.array(ring[1:])
    turns = np.zeros(len(rows), int)
    for at in range(0, n, 4000):
        ax, ay, bx, by = a[at : at + 4000, 0], a[at : at + 4000, 1], b[at : at + 4000, 0], b[at : at + 4000, 1]
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        turns += ((ay <= y) & (by > y) & (side > 0)).sum(axis=1) - ((by <= y) & (ay > y) & (side < 0)).sum(axis=1)
    assert inside == {int(i) for i in rows[turns != 0, 0]}
    spots.unpersist()
