"""Grid join against brute force over all pairs of a small fixture."""

import random

import pytest
from pyspark.sql import functions as F

from tests import shapes as sh
from tidegrid.functions import geometry as g
from tidegrid.operators.spatial_join import distance_join, spatial_join, with_overlap_area


@pytest.fixture(scope="module")
def left(spark):
    return sh.as_frame(spark, sh.mixed_polygons(70, 1), "a_id", "a_geom").persist()


@pytest.fixture(scope="module")
def right(spark):
    rows = sh.mixed_polygons(60, 2) + [(100 + i, r) for i, r in sh.mixed_polygons(9, 1)]
    return sh.as_frame(spark, rows, "b_id", "b_geom").persist()


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points are copies of one."""
    rng = random.Random(3)
    rows = [(i, 1.5, 1.25) if i % 3 == 0 else (i, rng.randrange(1024) / 16, rng.randrange(1024) / 16) for i in range(300)]
    rows.append((999, None, None))
    return spark.createDataFrame(rows, "p_id long, lon double, lat double").persist()


def ids(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


BRUTE = {
    "intersects": g.intersects, "overlaps": g.overlaps, "touches": g.touches,
    "contains": g.contains_polygon, "within": g.within_polygon, "equals": g.equals,
}


@pytest.mark.parametrize("predicate", list(BRUTE))
def test_polygons(spark, left, right, predicate):
    want = ids(left.crossJoin(right).where(BRUTE[predicate]("a_geom", "b_geom")), "a_id", "b_id")
    got = spatial_join(left, right, predicate, a_geom="a_geom", b_geom="b_geom")
    assert ids(got, "a_id", "b_id") == want
    assert want or predicate == "touches"
    split = spatial_join(
        left, right, predicate, a_geom="a_geom", b_geom="b_geom", split_hot=True, block_rows=2
    )
    assert ids(split, "a_id", "b_id") == want


def test_overlap_area_column(left, right):
    got = spatial_join(left, right, "intersects", a_geom="a_geom", b_geom="b_geom", overlap_area="shared")
    both = with_overlap_area(got, "a_geom", "b_geom", "again").select("shared", "again").collect()
    assert both and all(r["shared"] == pytest.approx(r["again"], abs=1e-12) for r in both)


def brute_points(left, points):
    return left.crossJoin(points).where(g.contains_xy("a_geom", "lon", "lat"))


def test_points(left, points):
    want = ids(brute_points(left, points), "a_id", "p_id")
    kw = {"a_geom": "a_geom", "b_geom": ("lon", "lat")}
    assert ids(spatial_join(left, points, "contains", **kw), "a_id", "p_id") == want
    split = spatial_join(left, points, "contains", split_hot=True, block_rows=5, **kw)
    assert ids(split, "a_id", "p_id") == want
    other_way = spatial_join(points, left, "within", a_geom=("lon", "lat"), b_geom="a_geom")
    assert ids(other_way, "a_id", "p_id") == want


def test_semi_and_anti(left, right, points):
    hit = {r[0] for r in ids(brute_points(left, points), "p_id")}
    kw = {"a_geom": ("lon", "lat"), "b_geom": "a_geom"}
    semi = spatial_join(points, left, "within", "left_semi", **kw)
    anti = spatial_join(points, left, "within", "left_anti", **kw)
    assert {r[0] for r in ids(semi, "p_id")} == hit
    assert {r[0] for r in ids(anti, "p_id")} == {r[0] for r in ids(points, "p_id")} - hit
    pairs = ids(left.crossJoin(right).where(g.intersects("a_geom", "b_geom")), "a_id")
    kept = spatial_join(left, right, "intersects", "left_semi", a_geom="a_geom", b_geom="b_geom", left_key="a_id")
    assert ids(kept, "a_id") == sorted(set(pairs))
    with pytest.raises(ValueError):
        spatial_join(left, right, "intersects", "left_semi", a_geom="a_geom", b_geom="b_geom")


def test_partition_keys_and_base_layer(left, right):
    a = left.withColumn("a_part", F.col("a_id") % 2)
    b = right.withColumn("b_part", F.col("b_id") % 2)
    want = ids(
        a.crossJoin(b).where("a_part = b_part").where(g.intersects("a_geom", "b_geom")), "a_id", "b_id"
    )
    got = spatial_join(
        a.where("a_id >= 0"), b, "intersects", a_geom="a_geom", b_geom="b_geom",
        partition_keys=[("a_part", "b_part")], a_layer=left, b_layer=right,
    )
    assert ids(got, "a_id", "b_id") == want


def test_distance_joins(left, right, points):
    other = points.select(F.col("p_id").alias("q_id"), F.col("lon").alias("qx"), F.col("lat").alias("qy"))
    near = F.sqrt((F.col("lon") - F.col("qx")) ** 2 + (F.col("lat") - F.col("qy")) ** 2) <= 1.5
    want = ids(points.crossJoin(other).where(near), "p_id", "q_id")
    got = distance_join(points, other, 1.5, a_geom=("lon", "lat"), b_geom=("qx", "qy"))
    assert ids(got, "p_id", "q_id") == want
    want = ids(left.crossJoin(points).where(g.distance_xy("a_geom", "lon", "lat") <= 2.0), "a_id", "p_id")
    got = distance_join(left, points, 2.0, a_geom="a_geom", b_geom=("lon", "lat"))
    assert ids(got, "a_id", "p_id") == want
    want = ids(left.crossJoin(right).where(g.dwithin("a_geom", "b_geom", 0.5)), "a_id", "b_id")
    got = distance_join(left, right, 0.5, a_geom="a_geom", b_geom="b_geom")
    assert ids(got, "a_id", "b_id") == want


def test_point_on_boundary(spark):
    area = sh.as_frame(spark, [(1, sh.UNIT)])
    points = spark.createDataFrame([(1, 4.0, 2.0), (2, 2.0, 2.0)], "p long, x double, y double")
    kw = {"b_geom": ("x", "y")}
    assert ids(spatial_join(area, points, "contains", **kw), "p") == [(2,)]
    assert ids(spatial_join(area, points, "touches", **kw), "p") == [(1,)]
    assert ids(spatial_join(area, points, "intersects", **kw), "p") == [(1,), (2,)]


def test_plan_has_no_nested_loop(spark, left, right):
    joined = spatial_join(left, right, "intersects", a_geom="a_geom", b_geom="b_geom")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_column_clash_is_reported(left):
    with pytest.raises(ValueError, match="rename"):
        spatial_join(left, left, "intersects", a_geom="a_geom", b_geom="a_geom")


def test_semi_and_anti_joins_respect_partition_keys(spark):
    area = spark.createDataFrame([("A", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]])], "part string, r array<array<struct<x:double,y:double>>>")
    area = area.select("part", g.make_polygon("r", "true").alias("shape"))
    points = spark.createDataFrame([(1, "A", 1.0, 1.0), (2, "B", 1.0, 1.0)], "p int, part string, lon double, lat double")
    kw = {"a_geom": ("lon", "lat"), "b_geom": "shape", "partition_keys": [("part", "part")]}
    # both sides have a column named part
    assert [r.p for r in spatial_join(points, area, "within", "left_semi", **kw).collect()] == [1]
    assert [r.p for r in spatial_join(points, area, "within", "left_anti", **kw).collect()] == [2]


def test_coincident_points(spark):
    a = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 3.0), (3, None, 0.5)], "a int, ax double, ay double")
    b = spark.createDataFrame([(7, 0.5, 0.5), (8, 0.5, 0.5000001)], "b int, bx double, by double")
    got = distance_join(a, b, 0.0, a_geom=("ax", "ay"), b_geom=("bx", "by")).collect()
    assert [(r.a, r.b, r.distance) for r in got] == [(1, 7, 0.0)]


def test_a_hot_cell_of_equal_rows_is_found_and_split(spark):
    area = spark.createDataFrame([([[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]],)] * 30, "r array<array<struct<x:double,y:double>>>")
    area = area.select(g.make_polygon("r", "true").alias("shape"))
    points = spark.createDataFrame([(1.0, 1.0)] * 50, "lon double, lat double")
    got = spatial_join(points, area, "within", a_geom=("lon", "lat"), b_geom="shape", block_rows=7)
    assert got.count() == 1500


def test_large_sides_are_not_broadcast(spark, tmp_path):
    """Outlines that repeat are small on disk, whatever room they take once they are decoded and in cells."""
    def stored(n, key, geom):
        corner = lambda x, y: f"named_struct('x', CAST(id + {x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"
        ring = ", ".join(corner(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
        squares = spark.range(n).selectExpr(f"id AS {key}", f"array(array({ring})) AS r")
        squares.select(key, g.make_polygon("r", "true").alias(geom)).write.parquet(f"{tmp_path}/{key}")
        return spark.read.parquet(f"{tmp_path}/{key}")

    def plan(a, b):
        joined = spatial_join(a, b, "touches", a_geom="a_geom", b_geom="b_geom", split_hot=False)
        return joined._jdf.queryExecution().executedPlan().toString()

    large, other, few = stored(6_000, "a_id", "a_geom"), stored(6_000, "b_id", "b_geom"), stored(50, "c_id", "b_geom")
    assert "Broadcast" not in plan(large, other)
    assert "BroadcastHashJoin" in plan(large, few)
