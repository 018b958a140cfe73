"""Joins that see every different geometry once, against brute force over all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_spatial_join import ids, left, points, right  # noqa: F401
from tests import shapes as sh
from tidegrid.functions import geometry as g
from tidegrid.operators import spatial_join as sj
from tidegrid.operators.copies import once
from tidegrid.plans.layers import DerivedLayers
from tidegrid.plans.registry import all_queries


@pytest.fixture
def joined_rows(monkeypatch):
    """Rows of either side of every join."""
    seen, candidates = [], sj._candidates

    def counting(a, b, *rest, **more):
        seen.append((a.df.count(), b.df.count()))
        return candidates(a, b, *rest, **more)

    monkeypatch.setattr(sj, "_candidates", counting)
    return seen


def copies(df, n):
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def test_copies_take_part_in_a_semi_join_once(spark, joined_rows):
    area = copies(sh.as_frame(spark, [(1, sh.UNIT), (2, sh.moved(sh.UNIT, 9, 9))]), 30)
    spots = copies(spark.createDataFrame([(1, 1.0, 1.0), (2, 7.0, 7.0), (3, None, 1.0)], "p int, x double, y double"), 50)
    kw = {"a_geom": ("x", "y"), "b_geom": "geometry"}
    assert sj.spatial_join(spots, area, "within", "left_semi", **kw).groupBy("p").count().collect() == [(1, 50)]
    dry = sj.spatial_join(spots, area, "within", "left_anti", **kw).groupBy("p").count().orderBy("p")
    assert [tuple(r) for r in dry.collect()] == [(2, 50), (3, 50)]
    # the second area lies outside the extent of the points
    assert joined_rows == [(2, 1), (2, 1)]
    other = area.select(F.col("id").alias("other_id"), F.col("geometry").alias("other"))
    kept = sj.spatial_join(area, other, "equals", "left_semi", b_geom="other", left_key="id")
    assert kept.groupBy("id").count().orderBy("id").collect() == [(1, 30), (2, 30)]
    assert joined_rows[2:] == [(2, 2)]


def test_matches_of_repeated_and_missing_keys(spark):
    """A key that stands at two geometries matches by either; a missing key never does."""
    rows = [(1, sh.UNIT), (1, sh.moved(sh.UNIT, 9, 9)), (None, sh.UNIT), (3, sh.moved(sh.UNIT, 20, 20))]
    area = sh.as_frame(spark, rows)
    spots = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    kw = {"b_geom": ("x", "y"), "left_key": "id"}
    assert ids(sj.spatial_join(area, spots, "contains", "left_semi", **kw), "id") == [(1,), (1,)]
    assert [r.id for r in sj.spatial_join(area, spots, "contains", "left_anti", **kw).orderBy("id").collect()] == [None, 3]


@pytest.mark.parametrize("cut_corners", [0, 1000])
def test_partners_are_counted_and_measured(left, right, joined_rows, cut_corners):
    a, b = copies(left, 2), copies(right.withColumn("part", F.col("b_id") % 2), 3).drop("copy")
    both = a.crossJoin(b).where(g.intersects("a_geom", "b_geom"))
    area = g.intersection_area("a_geom", "b_geom")
    want = both.groupBy("a_id", "copy").agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("shared"))
    got = sj.partner_counts(
        a, b, "intersects", a_geom="a_geom", b_geom="b_geom", overlap_area="shared", count="n", cut_corners=cut_corners
    )
    want, got = ({(r.a_id, r.copy): (r.n, r.shared) for r in f.collect()} for f in (want, got))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert max(joined_rows[0]) <= 70


def test_partners_with_equal_keys(left, right):
    a, b = left.withColumn("part", F.col("a_id") % 2), right.withColumn("part", F.col("b_id") % 2)
    other = b.withColumnRenamed("part", "other")
    want = a.crossJoin(other).where("part = other").where(g.intersects("a_geom", "b_geom")).groupBy("a_id").count()
    got = sj.partner_counts(a, b, "intersects", a_geom="a_geom", b_geom="b_geom", partition_keys=[("part", "part")])
    assert ids(got, "a_id", "n_partners") == ids(want, "a_id", "count")


def test_near_rows_are_counted(left, points, joined_rows):
    near = left.crossJoin(copies(points, 2)).withColumn("d", g.distance_xy("a_geom", "lon", "lat")).where("d <= 2.0")
    want = near.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("nearest"), F.sum("d").alias("total"))
    got = sj.near_counts(left, copies(points, 2), 2.0, a_geom="a_geom", b_geom=("lon", "lat"))
    want, got = ({r[0]: tuple(r)[1:] for r in f.collect()} for f in (want, got.drop("a_geom")))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert joined_rows[0][1] <= 201


def test_rings_that_end_elsewhere_are_other_outlines(spark):
    one = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = [(1, [one, one]), (2, [[*one, *one]]), (3, [one, one])]
    area = spark.createDataFrame(rows, "id long, r array<array<struct<x:double,y:double>>>")
    area = area.select("id", g.make_polygon("r", "false").alias("geometry"))
    assert sorted(r[0] for r in once(area, "geometry").select("__n").collect()) == [1, 2]


@pytest.mark.parametrize("predicate", ["intersects", "touches", "equals"])
def test_pairs_of_copies_come_from_pairs_of_outlines(left, right, joined_rows, predicate):
    a, b = copies(left, 3), copies(right, 2).withColumnRenamed("copy", "other_copy")
    brute = {"intersects": g.intersects, "touches": g.touches, "equals": g.equals}[predicate]
    columns = ["a_id", "copy", "b_id", "other_copy"]
    want = ids(a.crossJoin(b).where(brute("a_geom", "b_geom")), *columns)
    kw = {"a_geom": "a_geom", "b_geom": "b_geom", "copies_once": True}
    assert ids(sj.spatial_join(a, b, predicate, **kw), *columns) == want
    assert max(joined_rows[0]) <= 70
    # every geometry has more rows than a block
    assert ids(sj.spatial_join(a, b, predicate, block_rows=1, **kw), *columns) == want


def test_pairs_of_copies_with_keys_points_and_shared_areas(left, right, points):
    a = copies(left, 2).withColumn("part", F.col("a_id") % 2)
    b = right.withColumn("other", F.when(F.col("b_id") % 5 > 0, F.col("b_id") % 2))
    same = a.crossJoin(b).where("part = other").where(g.intersects("a_geom", "b_geom"))
    want = same.select("a_id", "copy", "b_id", g.intersection_area("a_geom", "b_geom").alias("shared"))
    got = sj.spatial_join(
        a, b, "intersects", a_geom="a_geom", b_geom="b_geom", partition_keys=[("part", "other")], overlap_area="shared",
        copies_once=True,
    )
    assert got.columns == [*a.columns, *b.columns, "shared"]
    want, got = ({tuple(r)[:3]: r["shared"] for r in f.collect()} for f in (want, got.select("a_id", "copy", "b_id", "shared")))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    spots = copies(points, 2)
    inside = ids(left.crossJoin(spots).where(g.contains_xy("a_geom", "lon", "lat")), "a_id", "p_id", "copy")
    found = sj.spatial_join(left, spots, "contains", a_geom="a_geom", b_geom=("lon", "lat"), copies_once=True)
    assert ids(found, "a_id", "p_id", "copy") == inside


@pytest.mark.parametrize("name", ["touching_neighbours", "polygon_equals"])
def test_tracts_of_one_outline_are_compared_once(spark, tmp_path, joined_rows, name):
    """Twenty suppliers at each of two places side by side; a row comes twice, keys and places are missing."""
    keys = [*range(0, 640, 32), *range(23, 640, 32)]
    rows = [(k, "s", 0) for k in [*keys, 0, None]] + [(5, "s", None)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    met = {"touching_neighbours": lambda x, y: x % 32 != y % 32, "polygon_equals": lambda x, y: x % 32 == y % 32}[name]
    want = [(f"48000{x:06}", f"48000{y:06}") for x in [*keys, 0] for y in [*keys, 0] if x < y and met(x, y)]
    got = all_queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert joined_rows == [(2, 2)]


def test_chain_of_copies_is_joined_by_outlines(spark, tmp_path, joined_rows):
    """Rows come again, outlines come again under other keys, and keys and places are missing."""
    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    stored("nation", [(n, f"n{n}") for n in [0, 1, 6, 6, None]], "n_nationkey int, n_name string")
    suppliers = [(k + 32 * c, "s", n) for n in (0, 1, 6) for k in range(8) for c in range(3)]
    suppliers += [suppliers[0], (None, "s", 0), (5, "s", None)]
    stored("supplier", suppliers, "s_suppkey long, s_name string, s_nationkey int")
    orders = [(k + c * 1280 * 1280, "1-URGENT") for k in range(400) for c in range(2)]
    stored("orders", [*orders, *orders[:300], (None, "1-URGENT")], "o_orderkey long, o_orderpriority string")

    layers = DerivedLayers(spark, str(tmp_path))
    tracts, zctas, floods = (layers[n].where("geometry.valid") for n in ("census_tracts", "zcta", "floodplain"))
    tracts = tracts.select(F.col("geometry").alias("t"))
    zctas = zctas.select(F.col("GEOID").alias("zcta_geoid"), F.col("geometry").alias("z"))
    rows = tracts.join(zctas, g.overlaps("t", "z")).join(floods, g.intersects("t", "geometry"))
    want = rows.groupBy("zcta_geoid").agg(F.count(F.lit(1)), F.count_distinct("GFID"))
    want = sorted(map(tuple, want.collect()))
    assert len(want) == 3 and all(n > 2 * k for _, n, k in want)
    got = all_queries()["three_polygon_chain"](spark, str(tmp_path))
    assert got.columns == ["zcta_geoid", "num_rows", "num_floods"]
    assert sorted(map(tuple, got.collect())) == want
    # rows of the floodplains meet what was found by merging
    assert re.search(r"\w+Join", got._jdf.queryExecution().executedPlan().toString())[0] == "SortMergeJoin"
    outlines = floods.select("geometry").distinct().count()
    assert outlines < floods.count() / 2
    assert joined_rows == [(24, 4), (24, outlines)]
