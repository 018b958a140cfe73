"""Joins along the catalog of legal layer connections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spatial_join import partner_counts, spatial_join

# Which columns connect two layers.
JOIN_RULES = {
    "direct": [
        ("claims.GEOID", "census_tracts.GEOID"),
        ("claims.GEOID", "nri.GEOID"),
        ("claims.GEOID", "svi.GEOID"),
        ("claims.GEOID", "cre.GEOID"),
        ("census_tracts.GEOID", "nri.GEOID"),
        ("census_tracts.GEOID", "svi.GEOID"),
        ("census_tracts.GEOID", "cre.GEOID"),
        ("hospitals.COUNTYFIPS", "county.GEOID"),
        ("hospitals.ZIP", "schools.ZIP"),
    ],
    "concat": [
        ("LEFT(claims.GEOID,5)", "county.GEOID"),
        ("LEFT(census_tracts.GEOID,5)", "county.GEOID"),
        ("LEFT(nri.GEOID,5)", "county.GEOID"),
        ("LEFT(svi.GEOID,5)", "county.GEOID"),
        ("LEFT(cre.GEOID,5)", "county.GEOID"),
    ],
    "point_polygon": [
        ("ST_Point(schools.LON, schools.LAT)", "census_tracts.geometry"),
        ("ST_Point(schools.LON, schools.LAT)", "floodplain.geometry"),
        ("ST_Point(schools.LON, schools.LAT)", "zcta.geometry"),
        ("ST_Point(schools.LON, schools.LAT)", "county.geometry"),
        ("ST_Point(hospitals.LON, hospitals.LAT)", "census_tracts.geometry"),
        ("ST_Point(hospitals.LON, hospitals.LAT)", "floodplain.geometry"),
        ("ST_Point(hospitals.LON, hospitals.LAT)", "zcta.geometry"),
        ("ST_Point(hospitals.LON, hospitals.LAT)", "county.geometry"),
    ],
    "polygon_polygon": [
        ("census_tracts.geometry", "floodplain.geometry"),
        ("census_tracts.geometry", "zcta.geometry"),
        ("floodplain.geometry", "zcta.geometry"),
        ("county.geometry", "floodplain.geometry"),
        ("county.geometry", "zcta.geometry"),
        ("county.geometry", "census_tracts.geometry"),
    ],
}

_LAYER = re.compile(r"(\w+)\.\w+")


def _layer_of(expr: str) -> str:
    return _LAYER.search(expr).group(1)


def join_rules(spark: SparkSession) -> DataFrame:
    """The catalog as a DataFrame (kind, left_expr, right_expr)."""
    rows = [(kind, left, right) for kind, pairs in JOIN_RULES.items() for left, right in pairs]
    return spark.createDataFrame(rows, "kind string, left_expr string, right_expr string")


def find_rules(a_name: str, b_name: str) -> list[tuple[str, str, str]]:
    """(kind, expression of a, expression of b) for every rule joining two layers."""
    found = []
    for kind, pairs in JOIN_RULES.items():
        for left, right in pairs:
            names = (_layer_of(left), _layer_of(right))
            if names == (a_name, b_name):
                found.append((kind, left, right))
            elif names == (b_name, a_name):
                found.append((kind, right, left))
    return found


def _key_column(df: DataFrame, expr: str) -> Column:
    column = df[expr.rstrip(")").split(".")[1].split(",")[0]]
    return F.left(column, F.lit(5)) if expr.startswith("LEFT(") else column


def join_layers(
    a: DataFrame,
    a_name: str,
    b: DataFrame,
    b_name: str,
    how: str = "inner",
    predicate: str | None = None,
    counted: str | None = None,
    **spatial,
) -> DataFrame:
    """Join two layers by the first rule of the catalog.

    Columns of ``b`` that also exist in ``a`` are prefixed with its layer name.
    A ``predicate`` asks for the spatial rule; without one a key rule is taken
    when there is one, else containment (points) or intersection (polygons).
    With ``counted`` the rows of ``a`` come out with their number of partners
    under that name, for a spatial rule (see ``partner_counts``).
    """
    rules = find_rules(a_name, b_name)
    wanted = [r for r in rules if (predicate is not None) == (r[0] in ("point_polygon", "polygon_polygon"))]
    rules = wanted or rules
    if not rules:
        raise ValueError(f"no join rule between {a_name} and {b_name}")
    kind, left, right = rules[0]
    b = b.withColumnsRenamed({c: f"{b_name}_{c}" for c in b.columns if c in a.columns})
    if kind in ("direct", "concat"):
        renamed = right if f"{b_name}_GEOID" not in b.columns else right.replace("GEOID", f"{b_name}_GEOID")
        if f"{b_name}_ZIP" in b.columns:
            renamed = renamed.replace("ZIP", f"{b_name}_ZIP")
        condition = _key_column(a, left) == _key_column(b, renamed)
        return a.join(b, condition, how)
    point_a, point_b = left.startswith("ST_Point"), right.startswith("ST_Point")
    b_geometry = f"{b_name}_geometry" if f"{b_name}_geometry" in b.columns else "geometry"
    b_point = tuple(f"{b_name}_{c}" if f"{b_name}_{c}" in b.columns else c for c in ("LON", "LAT"))
    if predicate is None:
        predicate = "within" if point_a else "contains" if point_b else "intersects"
    geoms = {"a_geom": ("LON", "LAT") if point_a else "geometry", "b_geom": b_point if point_b else b_geometry}
    if counted is not None:
        return partner_counts(a, b, predicate, count=counted, **geoms, **spatial)
    return spatial_join(a, b, predicate, how, **geoms, **spatial)
