"""Whole outlines: cut per cell and per slab, repaired, compared and measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.aggregates import coverage_share
from ..operators.make_valid import make_valid
from ..operators.outlines import same_outlines
from ..operators.spatial_join import near_counts, partner_counts
from . import sql as s
from .registry import query
from .single_layer import measured
from .spatial import XY, _floods, _hospitals, _pair_sql, _polygons, _sql_points, _tracts, row_count

# Every polygon of the test layers counts as large here.
ALL_LARGE = 3


@query(
    "hospitals_in_flood_by_cells",
    "WITH " + _sql_points("hospitals", "floodplain", "inside", "p.HOSPITAL_ID, g.GFID", "g.valid")
    + " SELECT GFID, COUNT(*) AS num_hospitals FROM inside GROUP BY GFID",
)
def hospitals_by_cells(layers):
    """Points in polygons with every outline cut per cell."""
    hosting = partner_counts(
        _floods(layers), _hospitals(layers), "contains", a_geom="flood_geom", b_geom=XY, cut_corners=ALL_LARGE
    )
    return hosting.groupBy("GFID").agg(F.sum("n_partners").alias("num_hospitals"))


@query(
    "coverage_share_by_slabs",
    _pair_sql("census_tracts", "floodplain", "met", "a_key AS GEOID, COUNT(*) AS num_floods,"
              " ROUND(SUM(shared) / ANY_VALUE(area_a), 6) AS share", "GROUP BY a_key"),
)
def coverage_by_slabs(layers):
    """Shared areas as sums over the slabs of both outlines."""
    pairs = partner_counts(
        _tracts(layers), _floods(layers), "intersects",
        a_geom="tract_geom", b_geom="flood_geom", overlap_area="shared", cut_corners=ALL_LARGE,
    )
    shares = coverage_share(pairs, ["GEOID"], "tract_geom", "shared").withColumn("share", F.round("share", 6))
    counts = pairs.groupBy("GEOID").agg(F.sum("n_partners").alias("num_floods"))
    return shares.join(counts, "GEOID")


def _damaged():
    """Rings left open, with every point twice, turned round, or as they are."""
    kind = F.pmod(F.col("GFID").cast("long"), F.lit(4))
    return (
        F.when(kind == 0, F.expr("transform(geometry.rings, r -> slice(r, 1, size(r) - 1))"))
        .when(kind == 1, F.expr("transform(geometry.rings, r -> flatten(transform(r, p -> array(p, p))))"))
        .when(kind == 2, F.expr("transform(geometry.rings, r -> reverse(r))"))
        .otherwise(F.col("geometry.rings"))
    )


@query(
    "repair_polygons",
    "SELECT GFID, true AS valid, CASE WHEN valid THEN len(rings) ELSE 2 END AS num_rings,"
    f" ROUND(CASE WHEN valid THEN {s.area('edges')} ELSE (xmax - xmin) * (ymax - ymin) / 2 END, 9) AS area FROM floodplain",
)
def repaired(layers):
    """Damaged outlines get their shape back; a bow-tie becomes the two triangles of its box."""
    damaged = layers["floodplain"].select("GFID", _damaged().alias("__r"))
    damaged = damaged.select("GFID", g.make_polygon("__r", "false").alias("geometry"))
    fixed = measured(make_valid(damaged, "GFID"))
    return fixed.select(
        "GFID", "valid", F.size("geometry.rings").cast("long").alias("num_rings"), F.round("area", 9).alias("area")
    )


@query(
    "equal_outlines",
    "WITH f AS (SELECT CAST(GFID AS BIGINT) AS id, list_sort(list_distinct(flatten(list_transform(rings, lambda r:"
    " list_transform(r, lambda v: [v.x, v.y]))))) AS corners FROM floodplain WHERE valid)"
    " SELECT a.id AS GFID, COUNT(*) AS num_equal FROM f a JOIN f b ON a.corners = b.corners GROUP BY a.id",
)
def equal_outlines(layers):
    """Floodplains whose outline is the same point set, however their rings are written down.

    One side starts its rings elsewhere, runs them backwards or has a point more on every edge.
    """
    floods = layers["floodplain"].where("geometry.valid").select(F.col("GFID").cast("long").alias("GFID"), "geometry")
    kind = F.pmod(F.col("GFID"), F.lit(3))
    other = F.when(kind == 0, F.expr("transform(geometry.rings, r -> concat(slice(r, 2, size(r) - 1), slice(r, 2, 1)))"))
    other = other.when(kind == 1, F.expr("transform(geometry.rings, r -> reverse(r))"))
    other = other.otherwise(
        F.expr(
            "transform(geometry.rings, r -> concat(flatten(zip_with(slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1),"
            " (u, v) -> array(u, named_struct('x', (u.x + v.x) / 2, 'y', (u.y + v.y) / 2)))), slice(r, 1, 1)))"
        )
    )
    written_otherwise = floods.select("GFID", other.alias("__r")).select(
        F.col("GFID").alias("other_id"), g.make_polygon("__r", "true").alias("other")
    )
    pairs = same_outlines(floods, written_otherwise, "geometry", "other")
    return pairs.groupBy("GFID").agg(row_count().alias("num_equal"))


def _polygon_distance_sql():
    def nearest(points, edges):
        dx, dy = "(p.bx - p.ax)", "(p.by - p.ay)"
        t = f"greatest(0, least(1, ((q.ax - p.ax) * {dx} + (q.ay - p.ay) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
        gx, gy = f"(p.ax + {t} * {dx} - q.ax)", f"(p.ay + {t} * {dy} - q.ay)"
        return f"list_min(list_transform({points}, lambda q: list_min(list_transform({edges}, lambda p: {gx} * {gx} + {gy} * {gy}))))"

    return (
        f"CASE WHEN {s.intersects('t', 'z')} THEN 0"
        f" ELSE sqrt(least({nearest('t.edges', 'z.edges')}, {nearest('z.edges', 't.edges')})) END"
    )


@query(
    "tracts_near_zcta",
    "SELECT zcta_geoid, COUNT(*) AS num_near, ROUND(SUM(distance), 6) AS total_distance FROM ("
    f"SELECT z.GEOID AS zcta_geoid, {_polygon_distance_sql()} AS distance FROM census_tracts t JOIN zcta z"
    " ON t.xmin - 0.75 <= z.xmax AND z.xmin <= t.xmax + 0.75 AND t.ymin - 0.75 <= z.ymax AND z.ymin <= t.ymax + 0.75"
    " WHERE t.valid AND z.valid) WHERE distance <= 0.75 GROUP BY zcta_geoid",
)
def tracts_near_zcta(layers):
    """Polygons no further apart than a radius, zero where they meet."""
    areas = _polygons(layers, "zcta", F.col("GEOID").alias("zcta_geoid"), geom="zcta_geom")
    near = near_counts(areas, _tracts(layers), 0.75, a_geom="zcta_geom", b_geom="tract_geom")
    return near.groupBy("zcta_geoid").agg(
        F.sum("n_near").alias("num_near"), F.round(F.sum("total_distance"), 6).alias("total_distance")
    )
