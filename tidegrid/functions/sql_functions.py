"""ST_* functions for SQL text, as temporary SQL functions.

Catalyst inlines their bodies, so they cost what the expressions cost.  They
measure and filter rows; for joining two layers use ``spatial_join``, since a
predicate alone is planned as a nested loop.  Spark takes no SQL function inside
ORDER BY, so select the measure in a subquery and sort by its name.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import geometry as g

_GEOMETRY = (
    "STRUCT<rings: ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>, xmin: DOUBLE, ymin: DOUBLE,"
    " xmax: DOUBLE, ymax: DOUBLE, valid: BOOLEAN, corners: INT>"
)
_RECTANGLE = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
_NO_RINGS = "CAST(array() AS ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>)"


def _definitions() -> dict[str, tuple[str, str, str]]:
    """Function name -> (parameters, return type, body)."""
    a, b = g.Shape.of("a"), g.Shape.of("b")
    one, two = f"a {_GEOMETRY}", f"a {_GEOMETRY}, b {_GEOMETRY}"

    def dispatch(point_in_a, point_in_b, polygons):
        """A point has no rings; only its bounds count."""
        return (
            f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(b.rings) = 0 THEN {point_in_a}"
            f" WHEN size(a.rings) = 0 THEN {point_in_b} ELSE {polygons} END"
        )

    inside_a = g.contains_sql(a.edges, "b.xmin", "b.ymin")
    inside_b = g.contains_sql(b.edges, "a.xmin", "a.ymin")
    contains, within = g.predicate_sql("contains", a, b), g.predicate_sql("within", a, b)
    out = {
        "st_point": (
            "x DOUBLE, y DOUBLE", _GEOMETRY,
            "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN"
            f" named_struct('rings', {_NO_RINGS}, 'xmin', x, 'ymin', y, 'xmax', x, 'ymax', y, 'valid', true, 'corners', 0) END",
        ),
        "st_area": (one, "DOUBLE", g.polygon_area_sql("a")),
        "st_isvalid": (one, "BOOLEAN", "a.valid"),
        "st_envelope": (
            one, _RECTANGLE,
            "named_struct('xmin', a.xmin, 'ymin', a.ymin, 'xmax', a.xmax, 'ymax', a.ymax)",
        ),
        "st_contains": (two, "BOOLEAN", dispatch(inside_a, "false", contains)),
        "st_within": (two, "BOOLEAN", dispatch("false", inside_b, within)),
        "st_intersects": (
            two, "BOOLEAN",
            dispatch(
                g.covers_sql(a.edges, "b.xmin", "b.ymin"),
                g.covers_sql(b.edges, "a.xmin", "a.ymin"),
                g.predicate_sql("intersects", a, b),
            ),
        ),
        "st_intersectionarea": (two, "DOUBLE", g.overlap_area_sql(a, b)),
        "st_distance": (
            two, "DOUBLE",
            dispatch(
                g.point_polygon_distance_sql(a.edges, "b.xmin", "b.ymin"),
                g.point_polygon_distance_sql(b.edges, "a.xmin", "a.ymin"),
                g.distance_sql(a, b),
            ),
        ),
    }
    for name in ("overlaps", "touches", "equals"):
        out[f"st_{name}"] = (two, "BOOLEAN", g.predicate_sql(name, a, b))
    for bound in g.BOUNDS:
        out[f"st_{bound}"] = (one, "DOUBLE", f"a.{bound}")
    return out


def register_spatial_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    definitions = _definitions()
    for name, (parameters, returns, body) in definitions.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}"
        )
    return list(definitions)
