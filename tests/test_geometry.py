import pytest
from pyspark.sql import functions as F

from tests import shapes as sh
from tidegrid.functions import geometry as g
from tidegrid.operators.validity import flag_valid, repair_polygons


def one(spark, expr, **polygons):
    row = None
    for name, rings in polygons.items():
        frame = sh.as_frame(spark, [(1, rings)], "id", name)
        row = frame if row is None else row.join(frame, "id")
    return row.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "rings, area", [(sh.UNIT, 16), (sh.HOLED, 12), (sh.ELL, 12), (sh.DIAMOND, 8)]
)
def test_area(spark, rings, area):
    assert one(spark, g.polygon_area("a"), a=rings) == area
    # far from the origin nothing is lost
    assert one(spark, g.polygon_area("a"), a=sh.moved(rings, 1e6, -1e6)) == area


@pytest.mark.parametrize(
    "rings, valid",
    [
        (sh.UNIT, True), (sh.HOLED, True), (sh.ELL, True), (sh.DIAMOND, True),
        (sh.BOWTIE, False), (sh.SPIKE, False), (sh.OPEN, False),
        (sh.HOLE_OUTSIDE, False), (sh.HOLE_ACROSS, False), (sh.HOLE_TOUCHING, True),
    ],
)
def test_validity_in_row_and_by_edges(spark, rings, valid):
    frame = sh.as_frame(spark, [(1, rings)]).selectExpr("id", "geometry.rings AS rings", "geometry.valid AS row_valid")
    assert frame.first()["row_valid"] is valid
    for in_row_edges in (64, 0):
        assert flag_valid(frame, "id", "rings", in_row_edges=in_row_edges).first()["valid"] is valid


def test_validity_paths_agree_on_a_long_outline(spark):
    import math

    n = 400
    ring = [(math.cos(6.28 * i / n) * (10 + i % 2), math.sin(6.28 * i / n) * (10 + i % 2)) for i in range(n)]
    good = [[*ring, ring[0]]]
    far = (-2 * ring[200][0], -2 * ring[200][1])  # a spike through the other side
    crossed = [[*ring[:200], far, *ring[201:], ring[0]]]
    frame = sh.as_frame(spark, [(1, good), (2, crossed)]).selectExpr("id", "geometry.rings AS rings")
    got = {r["id"]: r["valid"] for r in flag_valid(frame, "id", "rings").collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize(
    "x, y, inside", [(0.5, 0.5, True), (2.0, 2.0, False), (1.0, 2.0, False), (0.0, 2.0, False), (5.0, 2.0, False)]
)
def test_contains_is_strict_and_knows_holes(spark, x, y, inside):
    frame = sh.as_frame(spark, [(1, sh.HOLED)]).withColumns({"x": F.lit(x), "y": F.lit(y)})
    assert frame.select(g.contains_xy("geometry", "x", "y")).first()[0] is inside


OVERLAPS = [
    (sh.UNIT, sh.moved(sh.UNIT, 2, 2), 4.0),
    (sh.HOLED, sh.moved(sh.UNIT, 2, 2), 3.0),
    (sh.ELL, sh.moved(sh.UNIT, 1, 1), 5.0),
    (sh.HOLED, sh.HOLED, 12.0),
    (sh.HOLED, sh.moved(sh.HOLED, 0.5, 0.5), 12.25 - 4.0 - 4.0 + 2.25),
    (sh.DIAMOND, sh.HOLED, 4.0),
    (sh.UNIT, sh.moved(sh.UNIT, 4, 0), 0.0),
    (sh.UNIT, sh.moved(sh.UNIT, 9, 9), 0.0),
    (sh.DIAMOND, sh.moved(sh.DIAMOND, 1, 0), 4.5),
    (sh.UNIT, sh.moved(sh.ELL, 1, -2), 4.0),
]


@pytest.mark.parametrize("a, b, area", OVERLAPS)
def test_overlap_area_both_ways(spark, a, b, area):
    assert one(spark, g.intersection_area("a", "b"), a=a, b=b) == pytest.approx(area, abs=1e-12)
    assert one(spark, g.intersection_area("b", "a"), a=a, b=b) == pytest.approx(area, abs=1e-12)


def test_predicates(spark):
    hole_filler = sh.moved(sh.UNIT, 1, 1, 0.5)
    cases = [
        (sh.UNIT, sh.moved(sh.UNIT, 2, 2), "intersects overlaps"),
        (sh.UNIT, sh.moved(sh.UNIT, 4, 0), "intersects touches"),
        (sh.UNIT, sh.moved(sh.UNIT, 4, 4), "intersects touches"),
        (sh.UNIT, sh.moved(sh.UNIT, 1, 1, 0.25), "intersects contains"),
        (sh.moved(sh.UNIT, 1, 1, 0.25), sh.UNIT, "intersects within"),
        (sh.UNIT, sh.UNIT, "intersects contains within equals"),
        (sh.HOLED, sh.moved(sh.UNIT, 1.5, 1.5, 0.25), ""),
        (sh.HOLED, hole_filler, "intersects touches"),
        (sh.UNIT, sh.HOLED, "intersects contains"),
        (sh.ELL, sh.moved(sh.UNIT, 2.5, 2.5, 0.25), ""),
    ]
    tests = {
        "intersects": g.intersects, "overlaps": g.overlaps, "touches": g.touches,
        "contains": g.contains_polygon, "within": g.within_polygon, "equals": g.equals,
    }
    left = sh.as_frame(spark, [(i, c[0]) for i, c in enumerate(cases)], "id", "a")
    right = sh.as_frame(spark, [(i, c[1]) for i, c in enumerate(cases)], "id", "b")
    rows = left.join(right, "id").select("id", *[t("a", "b").alias(n) for n, t in tests.items()])
    for row in rows.collect():
        held = {n for n in tests if row[n]}
        assert held == set(cases[row["id"]][2].split()), row


def test_distances(spark):
    assert one(spark, g.distance("a", "b"), a=sh.UNIT, b=sh.moved(sh.UNIT, 7, 8)) == 5.0
    assert one(spark, g.distance("a", "b"), a=sh.UNIT, b=sh.moved(sh.UNIT, 2, 2)) == 0.0
    assert one(spark, g.dwithin("a", "b", 4.9), a=sh.UNIT, b=sh.moved(sh.UNIT, 7, 8)) is False
    frame = sh.as_frame(spark, [(1, sh.HOLED)]).withColumns({"x": F.lit(2.0), "y": F.lit(2.25)})
    assert frame.select(g.distance_xy("geometry", "x", "y")).first()[0] == 0.75
    assert one(spark, g.crosses("a", "b"), a=sh.UNIT, b=sh.ELL) is False


def test_repair(spark):
    repeated = [[(0.0, 0.0), (0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]]  # open, clockwise, repeat
    frame = sh.as_frame(spark, [(1, repeated), (2, sh.BOWTIE), (3, sh.HOLED)])
    fixed = repair_polygons(frame, "id").select("id", "geometry.valid", g.polygon_area("geometry").alias("area"))
    got = {r["id"]: (r["valid"], r["area"]) for r in fixed.collect()}
    assert got[1] == (True, 16.0)
    assert got[2][0] is False
    assert got[3] == (True, 12.0)


def test_mercator_and_envelope(spark):
    xy = spark.range(1).selectExpr("180D AS lon", "0D AS lat").select(g.mercator_xy("lon", "lat").alias("p")).first()["p"]
    assert xy["x"] == pytest.approx(20037508.342789244) and xy["y"] == pytest.approx(0, abs=1e-6)
    box = one(spark, g.envelope("a"), a=sh.moved(sh.DIAMOND, 1, 2))
    assert tuple(box) == (1.0, 2.0, 5.0, 6.0)


def test_parts_and_nesting(spark):
    """Multipolygons keep their parts when oriented; shells directly in shells are invalid."""
    def box(a, b, turned=False):
        ring = [(a, a), (b, a), (b, b), (a, b), (a, a)]
        return ring[::-1] if turned else ring

    two = [box(0.0, 4.0), box(10.0, 12.0)]
    with_hole = [box(0.0, 6.0), box(1.0, 5.0, True)]
    island = [*with_hole, box(2.0, 3.0)]
    rows = [
        ("two", two, True), ("two turned", [r[::-1] for r in two], False), ("hole", with_hole, True), ("island", island, True),
        ("shell in shell", [box(0.0, 6.0), box(1.0, 5.0)], False), ("hole in hole", [*with_hole, box(2.0, 3.0, True)], False),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "name string, rings array<array<struct<x:double,y:double>>>")
    got = {r["name"]: r for r in df.select("name", g.is_valid("rings").alias("ok"), F.expr(g.orient_rings_sql("rings")).alias("r")).collect()}
    assert {n: got[n].ok for n, *_ in rows if n != "two turned"} == {n: ok for n, _, ok in rows if n != "two turned"}
    for name, want in (("two", two), ("two turned", two), ("island", island)):
        area = spark.createDataFrame([([[tuple(p) for p in r] for r in got[name].r],)], "r array<array<struct<x:double,y:double>>>")
        area = area.select(g.make_polygon("r", "true").alias("s")).select(g.polygon_area("s").alias("a")).first().a
        assert area == {"two": 20.0, "two turned": 20.0, "island": 21.0}[name]


def test_validity_does_not_hang_on_keys_or_size(spark):
    import math

    from tidegrid.operators.validity import flag_valid

    def circle(n, x):
        ring = [(x + math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
        return [[*ring, ring[0]]]

    def bow(n):
        top = [(k / n * 4.0, 4.0 - k / n * 4.0) for k in range(n)]
        return [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), *reversed(top[1:-1]), (0.0, 4.0), (0.0, 0.0)]]

    for n in (20, 90):
        rows = [(None, circle(n, 0.0)), ("k", circle(n, 0.0)), ("k", circle(n, 0.5)), (None, bow(n))]
        df = spark.createDataFrame(rows, "key string, rings array<array<struct<x:double,y:double>>>")
        got = flag_valid(df, "key", "rings").withColumn("corners", F.expr("rings[0][0].x = 0 AND rings[0][1].x = 4")).collect()
        assert sorted(r.valid for r in got) == [False, True, True, True] and [r.valid for r in got if r.corners] == [False]
