from tests import shapes as sh
from tidegrid.functions.sql_functions import register_spatial_functions
from tidegrid.plans.layers import DerivedLayers
from tidegrid.plans.registry import all_queries
from tidegrid.sources.layers import register_views

SF = "/root/testdata/sf0.001"


def test_gold_text_runs_on_views(spark):
    register_spatial_functions(spark)
    layers = DerivedLayers(spark, SF)
    register_views({n: layers[n] for n in ("floodplain", "county", "claims", "hospitals", "census_tracts")})

    def same(name, text):
        assert spark.sql(text).first()[0] == all_queries()[name](spark, SF).first()[0]

    same("sum_area_valid_zone",
         "SELECT ROUND(SUM(ST_Area(geometry)), 6) AS total_ae_area FROM floodplain"
         " WHERE STATEFP='12' AND FLD_ZONE='AE' AND ST_IsValid(geometry)")
    same("bbox_filter",
         "SELECT COUNT(*) AS n FROM county WHERE STATEFP = '12' AND ST_XMax(geometry) < 9"
         " AND ST_YMin(geometry) > 1 AND ST_IsValid(geometry)")
    same("smallest_area_key",
         "SELECT GFID FROM (SELECT GFID, ST_Area(geometry) AS area FROM floodplain WHERE STATEFP = '22')"
         " ORDER BY area ASC, GFID LIMIT 1")
    same("count_prefix_date",
         "SELECT COUNT(*) AS num_claims FROM claims WHERE GEOID LIKE '48010%' AND dateOfLoss >= DATE '1998-01-01'")


def test_predicates_on_pairs(spark):
    register_spatial_functions(spark)
    a = sh.as_frame(spark, [(1, sh.HOLED)], "id", "a")
    b = sh.as_frame(spark, [(1, sh.moved(sh.UNIT, 2, 2))], "id", "b")
    a.join(b, "id").createOrReplaceTempView("pairs_of_polygons")
    row = spark.sql(
        "SELECT ST_Contains(a, ST_Point(0.5D, 0.5D)) AS c, ST_Contains(a, ST_Point(2D, 2D)) AS h,"
        " ST_Within(ST_Point(0.5D, 0.5D), a) AS w, ST_Intersects(a, b) AS i, ST_Overlaps(a, b) AS o,"
        " ST_Touches(a, b) AS t, ST_Equals(a, a) AS e, ST_IntersectionArea(a, b) AS s,"
        " ST_Distance(a, ST_Point(7D, 8D)) AS d, ST_Envelope(a).xmax AS x, ST_Contains(a, ST_Point(NULL, 1D)) AS n"
        " FROM pairs_of_polygons"
    ).first()
    assert tuple(row) == (True, False, True, True, True, False, True, 3.0, 5.0, 4.0, None)
