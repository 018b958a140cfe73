"""Validity check and limited repair of polygon layers.

Small polygons are checked inside their row.  For large ones the edges go into
cells of a grid as large as the edge itself, and only edges of the same polygon
and cell are compared, each pair on the level of the longer one.  A polygon
with a million corners is thus many small cells, not one quadratic row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.storage import written

# Up to this many edges all pairs of a row are compared in place.
IN_ROW_EDGES = 64

_EDGE = ("ring", "pos", "len", "ax", "ay", "bx", "by")
_CELL = ("__level", "__cx", "__cy")

_EDGE_LEVEL = "int(ceil(log2(greatest(abs(bx - ax), abs(by - ay), 1e-12D))))"


def _edge_cells(level: str, own: str) -> str:
    size = f"pow(2D, {level})"

    def span(a, b):
        return f"sequence(floor(least({a}, {b}) / {size}), floor(greatest({a}, {b}) / {size}))"

    return (
        f"flatten(transform({span('ax', 'bx')}, cx_ -> transform({span('ay', 'by')}, cy_ ->"
        f" named_struct('__level', {level}, '__cx', cx_, '__cy', cy_, '__own', {own}))))"
    )


def _edge_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per edge and cell, from a column ``__es`` of numbered edges.  An
    edge owns the cells of its own length and visits those of longer edges of
    the same polygon."""
    level_of_item = _EDGE_LEVEL.replace("bx", "e_.bx").replace("ax", "e_.ax")
    level_of_item = level_of_item.replace("by", "e_.by").replace("ay", "e_.ay")
    visited = (
        f"flatten(transform(filter(__levels, lv_ -> lv_ > __edge_level),"
        f" lv_ -> {_edge_cells('lv_', 'false')}))"
    )
    return (
        df.selectExpr(*key, f"array_distinct(transform(__es, e_ -> {level_of_item})) AS __levels", "__es")
        .selectExpr(*key, "__levels", "inline(__es)")
        .selectExpr("*", f"{_EDGE_LEVEL} AS __edge_level")
        .selectExpr(
            *key,
            f"struct({', '.join(_EDGE)}) AS __edge",
            f"inline(concat({_edge_cells('__edge_level', 'true')}, {visited}))",
        )
    )


def clashing_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of polygons whose numbered edges ``__es`` cross, overlap or fold back."""
    key = list(key)
    rows = _edge_rows(df, key)
    others = rows.withColumnsRenamed({"__edge": "__other", "__own": "__other_own"})
    clash = (
        f"__own AND ({g.later_sql('__edge', '__other')} OR NOT __other_own)"
        f" AND {g.clash_sql('__edge', '__other')}"
    )
    return rows.join(others, [*key, *_CELL]).where(clash).select(*key).distinct()


def _outline_code(rings: str, names: Sequence[str]) -> list[str]:
    """Two columns of 64 bits that tell outlines apart.

    Hashes run through nested arrays, see no ends of rings and skip what is null, so the lengths of the rings and the
    places without coordinates are hashed too.
    """
    lengths = f"transform({rings}, r_ -> size(r_))"
    missing = f"transform(flatten({rings}), p_ -> int(p_.x IS NULL) + 2 * int(p_.y IS NULL))"
    told = f"{rings} IS NULL, {lengths}, {missing}, {rings}"
    return [f"xxhash64({told}) AS {names[0]}", f"xxhash64(17, {told}) AS {names[1]}"]


def flag_valid(
    df: DataFrame,
    key: Sequence[str] | str,
    rings: str,
    flag: str = "valid",
    in_row_edges: int = IN_ROW_EDGES,
) -> DataFrame:
    """Add a boolean column telling whether each polygon is valid.

    Every different outline is checked once, large ones under 128 bits of the
    outline itself, so null and repeated keys do not matter; ``key`` is kept
    for callers and not needed to tell rows apart.
    """
    columns = [c for c in df.columns if c != flag]
    rows = df.select(*columns)
    corners = f"aggregate({rings}, 0, (n_, r_) -> n_ + size(r_))"
    small = F.expr(f"coalesce({corners}, 0) <= {in_row_edges}")
    shape_ok = g.shape_ok_sql("__clean")

    def staged(df: DataFrame) -> DataFrame:
        cleaned = df.withColumn("__clean", F.expr(g.clean_rings_sql(rings)))
        return cleaned.withColumn("__es", F.expr(g.numbered_edges_sql("__clean")))

    # Every different outline once; only those found unsound go back to the rows, by their code, so that neither side of
    # that join is sorted by whole outlines.  The flag is stored before it is asked for, since a filter on it would work
    # the edges out again for each of its terms.
    outline = ["__outline_a", "__outline_b"]
    in_code = _outline_code(rings, outline)
    sound = f"coalesce({shape_ok} AND NOT {g.clashes_in_row_sql('__es')}, false)"
    different = staged(rows.where(small).select(rings).distinct())
    checked = written(different.selectExpr(*in_code, f"{sound} AS __sound"), "checked-outlines")
    unsound = written(checked.where("NOT __sound").select(*outline, F.lit(True).alias("__found")), "unsound-outlines")
    in_row = rows.where(small).selectExpr("*", *in_code).join(unsound, outline, "left").selectExpr(
        *[f"`{c}`" for c in columns], f"__found IS NULL AS {flag}"
    )
    large = staged(rows.where(~small)).selectExpr(
        "*", "xxhash64(__es) AS __outline_a", "xxhash64(17, __es) AS __outline_b"
    )
    shapes = large.select(*outline, "__es").dropDuplicates(outline)
    bad = clashing_keys(shapes, outline).withColumn("__clash", F.lit(True))
    by_edges = large.join(bad, outline, "left").selectExpr(
        *columns, f"coalesce({shape_ok} AND __clash IS NULL, false) AS {flag}"
    )
    return in_row.unionByName(by_edges)


def with_geometry(
    df: DataFrame, key: Sequence[str] | str, rings: str, name: str = "geometry"
) -> DataFrame:
    """Replace a rings column by the full geometry struct (bounds, validity)."""
    flagged = flag_valid(df, key, rings, "__valid")
    kept = [c for c in df.columns if c not in (rings, name)]
    return flagged.select(*kept, g.make_polygon(rings, "__valid").alias(name))


def repaired_rings_sql(rings: str) -> str:
    """Drop repeated points, close open rings, drop rings without area, set orientation."""
    closed = (
        "CASE WHEN r_[0] = element_at(r_, -1) THEN r_ ELSE concat(r_, slice(r_, 1, 1)) END"
    )
    enough = f"filter({g.clean_rings_sql(rings)}, r_ -> size(r_) >= 3)"
    tidy = f"filter(transform({enough}, r_ -> {closed}), r_ -> size(r_) >= 4)"
    return g.orient_rings_sql(tidy)


def repair_polygons(
    df: DataFrame, key: Sequence[str] | str, geom: str = "geometry"
) -> DataFrame:
    """Limited repair; rows that stay invalid keep valid = false in the geometry."""
    rebuilt = df.withColumn("__rings", F.expr(repaired_rings_sql(f"{geom}.rings"))).drop(geom)
    return with_geometry(rebuilt, key, "__rings", geom)
