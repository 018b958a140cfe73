"""Large polygons cut per cell, for joins with points.

A polygon is laid over an adaptive grid: its box is split into 2 x 2 cells, and a
cell that more than ``EDGES_A_CELL`` edges touch into 8 x 8 smaller ones, and so
on.  What comes out are *partial* cells with just the edges that touch them and
*full* cells without any, which lie wholly inside.  Cells outside are left out,
so a million corners become some ten thousand rows of bounded size, and no task
ever holds a whole outline.

A cell also has the winding number of the polygon around its lower right corner,
seen a hair further right and up.  For a point of the cell the winding number
then follows from the cell's own edges: walk from the corner up the right side
to the height of the point and from there left to the point, and count the edges
that are crossed, with the same half-open rule as the winding number of a whole
outline.  A full cell answers without geometry.

The corners of child cells are worked out in the same way from the edges of
their parent, and the first corner lies to the right of the whole polygon, where
the number is zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.storage import written

# A cell with more edges is split further.
EDGES_A_CELL = 256

# Children of a cell along one side, as a power of two.
_SPLIT = 3

# Splits at most; 2**37 cells along one side.  Only edges that meet in one spot are left together then.
_ROUNDS = 12

_KEY = ["__pid", "__lv", "__cx", "__cy"]


def _right_sql(e: str, x: str, y: str) -> str:
    """Signed crossing of the edge by the ray from (x, y) to the right."""
    side = g.orient_sql(e, x, y)
    return (
        f"CASE WHEN {e}.ay <= {y} THEN CASE WHEN {e}.by > {y} AND {side} > 0 THEN 1 ELSE 0 END"
        f" WHEN {e}.by <= {y} AND {side} < 0 THEN -1 ELSE 0 END"
    )


def _above_sql(e: str, x: str, y: str) -> str:
    """1 if a point a hair right of, and less up from, (x, y) is above the edge."""
    side = g.orient_sql(e, x, y)
    return (
        f"CASE WHEN {e}.ax < {e}.bx THEN CASE WHEN {side} > 0 OR ({side} = 0 AND {e}.by <= {e}.ay) THEN 1 ELSE 0 END"
        f" ELSE CASE WHEN {side} < 0 OR ({side} = 0 AND {e}.by >= {e}.ay) THEN 1 ELSE 0 END END"
    )


def _spans_sql(e: str, c: str, v: str) -> str:
    """The edge passes from one side of v to the other along axis c (x or y)."""
    return f"(least({e}.a{c}, {e}.b{c}) <= {v} AND {v} < greatest({e}.a{c}, {e}.b{c}))"


def turns_sql(e: str, x: str, y: str, x1: str, y0: str) -> str:
    """What the edge adds to the winding number on the way from (x1, y0) up to (x1, y) and left to (x, y)."""
    climb = f"({_above_sql(e, x1, y)}) - ({_above_sql(e, x1, y0)})"
    return (
        f"(({_right_sql(e, x, y)}) - ({_right_sql(e, x1, y)})"
        f" + CASE WHEN {_spans_sql(e, 'x', x1)} THEN CASE WHEN {e}.ax < {e}.bx THEN {climb} ELSE -({climb}) END ELSE 0 END)"
    )


def _range_sql(low: str, high: str) -> str:
    return f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def _touched_sql(k: int) -> str:
    """Child cells of the parent at (__ox, __oy) whose closed box the edge ``e`` meets."""

    def span(c):
        low = f"greatest(CAST(ceil(least(e.a{c}, e.b{c}) / __size) AS BIGINT) - 1, __o{c})"
        high = f"least(CAST(floor(greatest(e.a{c}, e.b{c}) / __size) AS BIGINT), __o{c} + {k - 1})"
        return _range_sql(low, high)

    corners = [g.orient_sql("e", f"((cx_ + {i}) * __size)", f"((cy_ + {j}) * __size)") for i in (0, 1) for j in (0, 1)]
    meets = f"greatest({', '.join(corners)}) >= 0 AND least({', '.join(corners)}) <= 0"
    return (
        f"flatten(transform({span('x')}, cx_ -> transform(filter({span('y')}, cy_ -> {meets}),"
        " cy_ -> named_struct('__cx', cx_, '__cy', cy_))))"
    )


def _turns_of_children_sql(k: int) -> str:
    """Child cells whose corner the edge ``e`` adds to, relative to the parent's corner."""
    y = "((__oy + i_) * __size)"
    x1, y0 = f"((__ox + {k}) * __size)", "(__oy * __size)"
    turns = turns_sql("e", "((__ox + j_ + 1) * __size)", y, x1, y0)
    rows = f"filter(sequence(0, {k - 1}), i_ -> {_spans_sql('e', 'y', y)} OR {_spans_sql('e', 'x', x1)})"
    return (
        f"filter(flatten(transform({rows}, i_ -> transform(sequence(0, {k - 1}), j_ ->"
        f" named_struct('__cx', __ox + j_, '__cy', __oy + i_, '__d', {turns})))), c_ -> c_.__d <> 0)"
    )


def _split(parents: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Children of the parents with their winding number and number of edges, and the edges in the children."""
    touched = written(
        edges.selectExpr("__pid", "__lv", f"inline({_touched_sql(k)})", "e").select(*_KEY, "e"), "cell-edges"
    )
    turns = edges.selectExpr("__pid", "__lv", f"inline({_turns_of_children_sql(k)})").groupBy(*_KEY).agg(
        F.sum("__d").cast("int").alias("__d")
    )
    counts = touched.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__n"))
    along = f"sequence(0, {k - 1})"
    children = parents.selectExpr(
        "__pid", "__lv", "__w AS __from",
        f"inline(flatten(transform({along}, i_ -> transform({along}, j_ ->"
        " named_struct('__cx', __ox + j_, '__cy', __oy + i_)))))",
    )
    found = (
        children.join(turns, _KEY, "left")
        .join(counts, _KEY, "left")
        .selectExpr(*_KEY, "__from + coalesce(__d, 0) AS __w", "coalesce(__n, 0) AS __n")
        .where("__n > 0 OR __w <> 0")
    )
    return written(found, "cells"), touched


def cell_cover(shapes: DataFrame, geom: str, edges_a_cell: int = EDGES_A_CELL) -> DataFrame:
    """__pid, __lv, __cx, __cy, __w, __edges: the cells of every polygon.

    ``shapes`` has __pid, a number of the polygon, and the geometry.  Cell
    (__cx, __cy) of level __lv covers the square with the lower left corner
    (__cx, __cy) * 2**__lv, without its upper and right side; cells of a polygon
    do not overlap.  __edges is empty for a full cell.  Work goes by rounds of
    splitting until no cell is crowded; each round is written, so that it is not
    done twice and survives a lost executor.
    """
    extent = f"greatest({geom}.xmax - {geom}.xmin, {geom}.ymax - {geom}.ymin)"
    roots = shapes.selectExpr("*", f"CASE WHEN {extent} > 0 THEN int(ceil(log2({extent}))) ELSE 0 END AS __lv").selectExpr(
        "*",
        f"CAST(floor({geom}.xmin / pow(2D, __lv)) AS BIGINT) AS __ox",
        f"CAST(floor({geom}.ymin / pow(2D, __lv)) AS BIGINT) AS __oy",
    )
    parents = roots.selectExpr("__pid", "__lv", "__ox", "__oy", "0 AS __w")
    edges = roots.selectExpr(
        "__pid", "__lv", "__ox", "__oy", "pow(2D, __lv) AS __size", f"explode({g.edges_sql(f'{geom}.rings')}) AS e"
    )
    parts = []
    k = 2
    for round_no in range(_ROUNDS + 1):
        cells, touched = _split(parents, edges, k)
        parts.append(
            cells.where("__n = 0").selectExpr(
                *_KEY, "__w", "CAST(array() AS ARRAY<STRUCT<ax: DOUBLE, ay: DOUBLE, bx: DOUBLE, by: DOUBLE>>) AS __edges"
            )
        )
        crowded = cells.where(F.col("__n") > edges_a_cell)
        last = round_no == _ROUNDS or crowded.isEmpty()
        few = cells.where("__n > 0" if last else f"__n BETWEEN 1 AND {edges_a_cell}")
        parts.append(
            touched.join(few.select(*_KEY, "__w"), _KEY)
            .groupBy(*_KEY)
            .agg(F.first("__w").alias("__w"), F.collect_list("e").alias("__edges"))
        )
        if last:
            break
        k = 1 << _SPLIT
        down = ["__pid", f"__lv - {_SPLIT} AS __lv", f"__cx * {k} AS __ox", f"__cy * {k} AS __oy"]
        parents = crowded.selectExpr(*down, "__w")
        edges = (
            touched.join(crowded.select(*_KEY), _KEY)
            .selectExpr(*down, "e")
            .selectExpr("__pid", "__lv", "__ox", "__oy", "pow(2D, __lv) AS __size", "e")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return written(out, "cell-cover")


def point_in_cell_sql(predicate: str, x: str, y: str) -> str:
    """The polygon of a cover row contains, intersects or touches the point, which lies in the cell."""
    x1, y0 = "((__cx + 1) * pow(2D, __lv))", "(__cy * pow(2D, __lv))"
    winding = f"aggregate(__edges, __w, (t_, e_) -> t_ + {turns_sql('e_', x, y, x1, y0)})"
    boundary = g.on_boundary_sql("__edges", x, y)
    if predicate == "contains":
        return f"CASE WHEN size(__edges) = 0 THEN true ELSE {winding} <> 0 AND NOT {boundary} END"
    if predicate == "intersects":
        return f"CASE WHEN size(__edges) = 0 THEN true ELSE {winding} <> 0 OR {boundary} END"
    if predicate == "touches":
        return boundary
    return "false"
