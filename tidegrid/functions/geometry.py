"""Planar geometry as SQL expressions.

A polygon (or multipolygon) travels as one struct column::

    struct<rings: array<array<struct<x: double, y: double>>>,
           xmin: double, ymin: double, xmax: double, ymax: double,
           valid: boolean, corners: int>

Rings are closed (first point repeated last) and oriented: outer rings run
counter-clockwise, holes clockwise.  With that convention every measure below
is a sum over directed edges, so holes and several parts need no special case.
Everything stays in the JVM; all coordinates are used as they are (lon/lat
degrees, so areas are square degrees).

The ``*_sql`` functions take and return expression text, to be put together
and parsed once; the others take column names (or expressions) and return a
Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS_TYPE = T.ArrayType(T.ArrayType(POINT_TYPE))
BOUNDS = ("xmin", "ymin", "xmax", "ymax")

# Areas closer than this share of the smaller polygon count as equal; it only
# absorbs rounding of the edge sums.
AREA_TOLERANCE = "1e-9D"


# -- building blocks ---------------------------------------------------------

def ring_edges_sql(ring: str) -> str:
    """Directed edges of one closed ring as array<struct<ax,ay,bx,by>>."""
    n = f"greatest(size({ring}) - 1, 0)"
    return (
        f"zip_with(slice({ring}, 1, {n}), slice({ring}, 2, {n}), (u_, v_) ->"
        " named_struct('ax', u_.x, 'ay', u_.y, 'bx', v_.x, 'by', v_.y))"
    )


def edges_sql(rings: str) -> str:
    """Directed edges of all rings in one flat array."""
    return f"flatten(transform({rings}, r_ -> {ring_edges_sql('r_')}))"


def starts_sql(rings: str) -> str:
    """First vertex of every non-empty ring."""
    return f"transform(filter({rings}, r_ -> size(r_) > 0), r_ -> r_[0])"


def orient_sql(s: str, x: str, y: str) -> str:
    """Twice the signed area of an edge and a point; positive when it is to the left."""
    return f"(({s}.bx - {s}.ax) * ({y} - {s}.ay) - ({s}.by - {s}.ay) * ({x} - {s}.ax))"


def _sum_sql(items: str, var: str, term: str) -> str:
    return f"aggregate({items}, 0D, (sum_{var}, {var}) -> sum_{var} + {term})"


def let_sql(var: str, value: str, body: str) -> str:
    """Body with a name for a value that is used several times in it."""
    return f"transform(array({value}), {var} -> {body})[0]"


def area_sql(edges: str) -> str:
    """Enclosed area of an edge array: trapezoids above the first corner."""
    base = f"coalesce({edges}[0].ay, 0D)"
    term = f"(t_.ax - t_.bx) * ((t_.ay - {base}) + (t_.by - {base})) / 2D"
    return f"abs({_sum_sql(edges, 't_', term)})"


def ring_area_sql(ring: str) -> str:
    """Signed area of one ring, positive when counter-clockwise."""
    return _sum_sql(ring_edges_sql(ring), "t_", "(t_.ax - t_.bx) * (t_.ay + t_.by) / 2D")


def polygon_area_sql(geom: str) -> str:
    term = f"(t_.ax - t_.bx) * (t_.ay + t_.by - 2D * {geom}.ymin) / 2D"
    return f"abs({_sum_sql(edges_sql(f'{geom}.rings'), 't_', term)})"


def polygon_area(geom: str) -> Column:
    """Planar area with holes taken out."""
    return F.expr(polygon_area_sql(geom))


def corners_sql(rings: str) -> str:
    """Number of points of all rings."""
    return f"aggregate({rings}, 0, (n_, r_) -> n_ + size(r_))"


def geometry_sql(rings: str, valid: str) -> str:
    """Geometry struct from a rings column and a validity flag."""

    def bound(fn, c):
        return f"{fn}(flatten(transform({rings}, r_ -> transform(r_, p_ -> p_.{c}))))"

    return (
        f"CASE WHEN {rings} IS NOT NULL THEN named_struct('rings', {rings},"
        f" 'xmin', {bound('array_min', 'x')}, 'ymin', {bound('array_min', 'y')},"
        f" 'xmax', {bound('array_max', 'x')}, 'ymax', {bound('array_max', 'y')},"
        f" 'valid', {valid}, 'corners', {corners_sql(rings)}) END"
    )


def make_polygon(rings: str, valid: str) -> Column:
    """Geometry struct; give ``rings`` as a plain column, it is used once per bound."""
    return F.expr(geometry_sql(rings, valid))


def envelope(geom: str) -> Column:
    """Bounding rectangle as struct<xmin,ymin,xmax,ymax>."""
    return F.struct(*[F.col(geom)[c].alias(c) for c in BOUNDS])


def nesting_sql(rings: str, ring: str, number: str) -> str:
    """How many other rings the ring lies in (rings do not cross in a sound outline)."""
    inside = contains_sql(ring_edges_sql("q_"), "corner_.x", "corner_.y")
    return f"size(filter({rings}, (q_, j_) -> j_ <> {number} AND exists({ring}, corner_ -> {inside})))"


def orient_rings_sql(rings: str) -> str:
    """Shells counter-clockwise, holes clockwise, whatever part they belong to.

    A ring inside an even number of others is a shell, else a hole, so the parts
    of a multipolygon keep their shells and islands in holes stay islands.
    """
    return (
        f"transform({rings}, (r_, i_) ->"
        f" CASE WHEN ({ring_area_sql('r_')} > 0) = ({nesting_sql(rings, 'r_', 'i_')} % 2 = 0)"
        " THEN r_ ELSE reverse(r_) END)"
    )


def canonical_rings_sql(rings: str) -> str:
    """Normal form of an outline: equal point sets have equal forms.

    Rings are oriented, lose points that repeat or lie straight between their
    neighbours, start at their least corner, and come in ascending order.
    """
    closed = (
        "CASE WHEN r_[0] = element_at(r_, -1) THEN slice(r_, 1, size(r_) - 1) ELSE r_ END"
    )
    before, after = "q_[(i_ + size(q_) - 1) % size(q_)]", "q_[(i_ + 1) % size(q_)]"
    straight = f"({after}.x - {before}.x) * (p_.y - {before}.y) = ({after}.y - {before}.y) * (p_.x - {before}.x)"
    corners = let_sql("q_", "s_", f"filter(q_, (p_, i_) -> NOT ({straight}))")
    first = "array_position(c_, array_min(c_))"
    turned = let_sql("c_", corners, f"concat(slice(c_, CAST({first} AS INT), size(c_)), slice(c_, 1, CAST({first} AS INT) - 1))")
    tidy = f"transform({clean_rings_sql(rings)}, r_ -> {closed})"
    solid = f"filter({tidy}, s_ -> size(s_) >= 3)"
    oriented = let_sql(
        "o_", f"transform({solid}, s_ -> concat(s_, slice(s_, 1, 1)))",
        f"transform({orient_rings_sql('o_')}, w_ -> slice(w_, 1, size(w_) - 1))",
    )
    return f"array_sort(filter(transform({oriented}, s_ -> {turned}), t_ -> size(t_) >= 3))"


# -- points against polygons -------------------------------------------------

def on_boundary_sql(edges: str, x: str, y: str) -> str:
    return (
        f"exists({edges}, b_ -> {orient_sql('b_', x, y)} = 0"
        f" AND {x} BETWEEN least(b_.ax, b_.bx) AND greatest(b_.ax, b_.bx)"
        f" AND {y} BETWEEN least(b_.ay, b_.by) AND greatest(b_.ay, b_.by))"
    )


def winding_sql(edges: str, x: str, y: str) -> str:
    """Winding number; holes run the other way round and cancel."""
    side = orient_sql("w_", x, y)
    return (
        f"aggregate({edges}, 0, (turns_, w_) -> turns_ + CASE"
        f" WHEN w_.ay <= {y} THEN CASE WHEN w_.by > {y} AND {side} > 0 THEN 1 ELSE 0 END"
        f" WHEN w_.by <= {y} AND {side} < 0 THEN -1 ELSE 0 END)"
    )


def contains_sql(edges: str, x: str, y: str) -> str:
    """Strictly inside; a point on the boundary is outside."""
    return f"({winding_sql(edges, x, y)} <> 0 AND NOT {on_boundary_sql(edges, x, y)})"


def covers_sql(edges: str, x: str, y: str) -> str:
    """Inside or on the boundary."""
    return f"({winding_sql(edges, x, y)} <> 0 OR {on_boundary_sql(edges, x, y)})"


def contains_xy(geom: str, x: str, y: str) -> Column:
    """The polygon strictly contains the point (x, y)."""
    return F.expr(
        f"{x} > {geom}.xmin AND {x} < {geom}.xmax AND {y} > {geom}.ymin AND {y} < {geom}.ymax"
        f" AND {contains_sql(edges_sql(f'{geom}.rings'), x, y)}"
    )


# -- polygons against polygons -----------------------------------------------

class Shape:
    """Parts of one polygon operand: edges, ring starts, bounds and area."""

    def __init__(self, edges, starts, xmin, ymin, xmax, ymax, area=None):
        self.edges, self.starts = edges, starts
        self.xmin, self.ymin, self.xmax, self.ymax = xmin, ymin, xmax, ymax
        self.area = area or area_sql(edges)

    @classmethod
    def of(cls, geom: str) -> Shape:
        return cls(
            edges_sql(f"{geom}.rings"), starts_sql(f"{geom}.rings"),
            *[f"{geom}.{c}" for c in BOUNDS],
        )


def boxes_meet_sql(a: Shape, b: Shape) -> str:
    return (
        f"({a.xmin} <= {b.xmax} AND {b.xmin} <= {a.xmax}"
        f" AND {a.ymin} <= {b.ymax} AND {b.ymin} <= {a.ymax})"
    )


def _apart_sql(e: str, f: str) -> str:
    """Sign of the sides on which the ends of e lie seen from f: negative when
    on different sides, zero when one is on the line, positive when on one side."""
    return (
        f"(signum({orient_sql(f, f'{e}.ax', f'{e}.ay')})"
        f" * signum({orient_sql(f, f'{e}.bx', f'{e}.by')}))"
    )


def segments_meet_sql(e: str, f: str) -> str:
    """Closed segments share at least one point."""

    def ranges(a, b):
        return (
            f"least({e}.{a}, {e}.{b}) <= greatest({f}.{a}, {f}.{b})"
            f" AND least({f}.{a}, {f}.{b}) <= greatest({e}.{a}, {e}.{b})"
        )

    return (
        f"({ranges('ax', 'bx')} AND {ranges('ay', 'by')}"
        f" AND {_apart_sql(e, f)} <= 0 AND {_apart_sql(f, e)} <= 0)"
    )


def _edges_in_box_sql(edges: str, var: str, box: Shape) -> str:
    return (
        f"filter({edges}, {var} -> least({var}.ax, {var}.bx) <= {box.xmax}"
        f" AND greatest({var}.ax, {var}.bx) >= {box.xmin}"
        f" AND least({var}.ay, {var}.by) <= {box.ymax}"
        f" AND greatest({var}.ay, {var}.by) >= {box.ymin})"
    )


def edges_meet_sql(a: Shape, b: Shape) -> str:
    """Two edges share a point, looking only at edges inside the other's box."""
    near_a, near_b = _edges_in_box_sql(a.edges, "e_", b), _edges_in_box_sql(b.edges, "f_", a)
    meet = f"exists({near_a}, e_ -> exists(near_, f_ -> {segments_meet_sql('e_', 'f_')}))"
    return let_sql("near_", near_b, meet)


def intersects_sql(a: Shape, b: Shape) -> str:
    """Any shared point.  Cheap tests first: a ring start of one polygon inside
    the other, then edge pairs."""
    return (
        f"({boxes_meet_sql(a, b)}"
        f" AND (exists({b.starts}, p_ -> {covers_sql(a.edges, 'p_.x', 'p_.y')})"
        f" OR exists({a.starts}, p_ -> {covers_sql(b.edges, 'p_.x', 'p_.y')})"
        f" OR {edges_meet_sql(a, b)}))"
    )


def _under_both_sql(lo: str, hi: str, base: str) -> str:
    """Signed area between base and the lower of edges e_ and f_ over [lo, hi].

    Straight piece from both ends; where the edges cross, the lower one changes
    at distance c from lo and the area is that of two pieces.
    """

    def height(s, x):
        return f"({s}.ay - {base} + ({x} - {s}.ax) * ({s}.by - {s}.ay) / ({s}.bx - {s}.ax))"

    ends = (
        f"named_struct('w', {hi} - {lo}, 'e0', {height('e_', lo)}, 'e1', {height('e_', hi)},"
        f" 'f0', {height('f_', lo)}, 'f1', {height('f_', hi)})"
    )
    m0, m1 = "least(h_.e0, h_.f0)", "least(h_.e1, h_.f1)"
    cut = "((h_.e0 - h_.f0) * h_.w / ((h_.e0 - h_.f0) - (h_.e1 - h_.f1)))"
    mid = f"(h_.e0 + {cut} * ((h_.e1 - h_.e0) / h_.w))"
    area = (
        "CASE WHEN signum(h_.e0 - h_.f0) * signum(h_.e1 - h_.f1) < 0"
        f" THEN ({m0} + {mid}) * {cut} / 2D + ({mid} + {m1}) * (h_.w - {cut}) / 2D"
        f" ELSE ({m0} + {m1}) * h_.w / 2D END"
    )
    return let_sql("h_", ends, area)


def overlap_area_sql(a: Shape, b: Shape) -> str:
    """area(A and B) without clipping; see ``overlap_sum_sql``."""
    return f"greatest({overlap_sum_sql(a, b)}, 0D)"


def overlap_sum_sql(a: Shape, b: Shape) -> str:
    """Over all pairs of directed edges, the signed area under the lower of the
    two.  Edges outside the common x range, or wholly below the other polygon,
    add up to nothing and are left out.  With all edges of both polygons this is
    the shared area inside the common x range of the shapes' boxes; sums over
    parts of the edges, or of the range, add up to it."""
    box = (
        f"named_struct('x0', greatest({a.xmin}, {b.xmin}), 'x1', least({a.xmax}, {b.xmax}),"
        f" 'y0', greatest({a.ymin}, {b.ymin}), 'y1', least({a.ymax}, {b.ymax}))"
    )

    def relevant(edges, v, floor):
        return (
            f"filter({edges}, {v} -> {v}.ax <> {v}.bx AND least({v}.ax, {v}.bx) < k_.x1"
            f" AND greatest({v}.ax, {v}.bx) > k_.x0 AND greatest({v}.ay, {v}.by) > {floor})"
        )

    span = (
        "named_struct('lo', greatest(least(e_.ax, e_.bx), least(f_.ax, f_.bx), k_.x0),"
        " 'hi', least(greatest(e_.ax, e_.bx), greatest(f_.ax, f_.bx), k_.x1))"
    )
    pair = let_sql(
        "l_", span,
        "CASE WHEN l_.lo < l_.hi THEN"
        " CASE WHEN (e_.ax > e_.bx) = (f_.ax > f_.bx) THEN 1D ELSE -1D END"
        f" * {_under_both_sql('l_.lo', 'l_.hi', 'k_.y0')} ELSE 0D END",
    )
    pairs = _sum_sql(relevant(a.edges, "e_", b.ymin), "e_", _sum_sql("near_", "f_", pair))
    total = let_sql("near_", relevant(b.edges, "f_", a.ymin), pairs)
    return let_sql(
        "k_", box,
        f"CASE WHEN k_.x0 < k_.x1 AND k_.y0 < k_.y1 THEN {total} ELSE 0D END",
    )


# Area predicates over a struct o_ of the shared area and both areas.
_AREA_TESTS = {
    "contains": f"o_.shared >= o_.b * (1D - {AREA_TOLERANCE})",
    "within": f"o_.shared >= o_.a * (1D - {AREA_TOLERANCE})",
    "equals": f"o_.shared >= greatest(o_.a, o_.b) * (1D - {AREA_TOLERANCE})",
    "overlaps": f"o_.shared > least(o_.a, o_.b) * {AREA_TOLERANCE}"
    f" AND o_.shared < least(o_.a, o_.b) * (1D - {AREA_TOLERANCE})",
    "touches": f"o_.shared <= least(o_.a, o_.b) * {AREA_TOLERANCE}",
}


def areas_sql(a: Shape, b: Shape) -> str:
    """struct<shared, a, b> of area(A and B), area(A), area(B)."""
    return f"named_struct('shared', {overlap_area_sql(a, b)}, 'a', {a.area}, 'b', {b.area})"


def area_test_sql(predicate: str, areas: str) -> str:
    """Area part of a predicate; a one-element filter names the struct, so that
    the areas are worked out once."""
    return f"exists(array({areas}), o_ -> {_AREA_TESTS[predicate]})"


def predicate_sql(predicate: str, a: Shape, b: Shape) -> str:
    """Polygon predicate by name.

    contains    all of B lies in A          within   all of A lies in B
    intersects  any shared point            equals   same point set
    overlaps    interiors meet, neither covers the other
    touches     boundaries meet, interiors do not
    """
    if predicate == "intersects":
        return intersects_sql(a, b)
    if predicate not in _AREA_TESTS:
        raise ValueError(f"unknown spatial predicate {predicate!r}")
    test = f"{boxes_meet_sql(a, b)} AND {area_test_sql(predicate, areas_sql(a, b))}"
    if predicate == "touches":
        test += f" AND {intersects_sql(a, b)}"
    return f"({test})"


def intersection_area(a: str, b: str) -> Column:
    """Area shared by two valid polygons."""
    return F.expr(overlap_area_sql(Shape.of(a), Shape.of(b)))


def _predicate(name: str, a: str, b: str) -> Column:
    return F.expr(predicate_sql(name, Shape.of(a), Shape.of(b)))


def intersects(a: str, b: str) -> Column:
    return _predicate("intersects", a, b)


def overlaps(a: str, b: str) -> Column:
    return _predicate("overlaps", a, b)


def touches(a: str, b: str) -> Column:
    return _predicate("touches", a, b)


def contains_polygon(a: str, b: str) -> Column:
    return _predicate("contains", a, b)


def within_polygon(a: str, b: str) -> Column:
    return _predicate("within", a, b)


def equals(a: str, b: str) -> Column:
    return _predicate("equals", a, b)


def crosses(a: str, b: str) -> Column:
    """Two areas never cross in the OGC sense (that needs a line)."""
    return F.expr(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN false END")


# -- distance ----------------------------------------------------------------

def point_distance_sql(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def _to_edge_sql(edges: str, v: str, x: str, y: str) -> str:
    """Squared distance from a point to the nearest of the edges."""
    dx, dy = f"({v}.bx - {v}.ax)", f"({v}.by - {v}.ay)"
    along = (
        f"coalesce(greatest(0D, least(1D, try_divide(({x} - {v}.ax) * {dx} + ({y} - {v}.ay) * {dy},"
        f" {dx} * {dx} + {dy} * {dy}))), 0D)"
    )
    gap_x, gap_y = f"({v}.ax + t_ * {dx} - {x})", f"({v}.ay + t_ * {dy} - {y})"
    square = f"transform(array({along}), t_ -> {gap_x} * {gap_x} + {gap_y} * {gap_y})[0]"
    return (
        f"aggregate({edges}, CAST('Infinity' AS DOUBLE), (near_{v}, {v}) -> least(near_{v}, {square}))"
    )


def point_polygon_distance_sql(edges: str, x: str, y: str) -> str:
    """Distance from a point to a polygon, zero inside."""
    return (
        f"CASE WHEN {covers_sql(edges, x, y)} THEN 0D ELSE sqrt({_to_edge_sql(edges, 'd_', x, y)}) END"
    )


def distance_sql(a: Shape, b: Shape) -> str:
    """Smallest distance of two polygons, zero when they meet."""

    def one_way(es, fs):
        nearest = _to_edge_sql(fs, "d_", "e_.ax", "e_.ay")
        return (
            f"aggregate({es}, CAST('Infinity' AS DOUBLE), (least_, e_) -> least(least_, {nearest}))"
        )

    return (
        f"CASE WHEN {intersects_sql(a, b)} THEN 0D"
        f" ELSE sqrt(least({one_way(a.edges, b.edges)}, {one_way(b.edges, a.edges)})) END"
    )


def distance_xy(geom: str, x: str, y: str) -> Column:
    return F.expr(point_polygon_distance_sql(edges_sql(f"{geom}.rings"), x, y))


def distance(a: str, b: str) -> Column:
    return F.expr(distance_sql(Shape.of(a), Shape.of(b)))


def dwithin(a: str, b: str, radius: float) -> Column:
    return distance(a, b) <= F.lit(float(radius))


# -- validity ----------------------------------------------------------------

def clean_rings_sql(rings: str) -> str:
    """Rings without consecutive repeats of the same point."""
    return (
        f"transform({rings}, r_ -> filter(r_, (p_, i_) -> i_ = 0"
        " OR p_.x <> r_[greatest(i_ - 1, 0)].x OR p_.y <> r_[greatest(i_ - 1, 0)].y))"
    )


def closed_sql(rings: str) -> str:
    """There are rings, each closed and with at least three corners."""
    return (
        f"(coalesce(size({rings}), 0) > 0 AND forall({rings}, r_ -> size(r_) >= 4"
        " AND r_[0].x = element_at(r_, -1).x AND r_[0].y = element_at(r_, -1).y))"
    )


def numbered_edges_sql(rings: str) -> str:
    """Edges with ring number, position and ring length, for validity checks."""
    return (
        f"flatten(transform({rings}, (r_, k_) -> transform({ring_edges_sql('r_')}, (e_, i_) ->"
        " named_struct('ring', k_, 'pos', i_, 'len', size(r_) - 1,"
        " 'ax', e_.ax, 'ay', e_.ay, 'bx', e_.bx, 'by', e_.by))))"
    )


def later_sql(e: str, f: str) -> str:
    """f comes after e in the numbering."""
    return f"({f}.ring > {e}.ring OR ({f}.ring = {e}.ring AND {f}.pos > {e}.pos))"


def clash_sql(e: str, f: str) -> str:
    """Two different numbered edges that cannot both be in a valid polygon:
    neighbours folding back, others of a ring meeting, rings cutting each other.
    Rings may meet in single points, but not cross or share a stretch."""
    ex, ey = f"({e}.bx - {e}.ax)", f"({e}.by - {e}.ay)"
    fx, fy = f"({f}.bx - {f}.ax)", f"({f}.by - {f}.ay)"
    parallel = f"{ex} * {fy} = {ey} * {fx}"

    def shared(a, b):
        return (
            f"(least(greatest({e}.{a}, {e}.{b}), greatest({f}.{a}, {f}.{b}))"
            f" - greatest(least({e}.{a}, {e}.{b}), least({f}.{a}, {f}.{b})))"
        )

    sx, sy = shared("ax", "bx"), shared("ay", "by")
    stretch = (
        f"{parallel} AND {orient_sql(f, f'{e}.ax', f'{e}.ay')} = 0"
        f" AND least({sx}, {sy}) >= 0 AND greatest({sx}, {sy}) > 0"
    )
    return (
        f"CASE WHEN {e}.ring <> {f}.ring"
        f" THEN ({_apart_sql(e, f)} < 0 AND {_apart_sql(f, e)} < 0) OR ({stretch})"
        f" WHEN abs({e}.pos - {f}.pos) IN (1, {e}.len - 1)"
        f" THEN {parallel} AND {ex} * {fx} + {ey} * {fy} < 0"
        f" ELSE {segments_meet_sql(e, f)} END"
    )


def holes_inside_sql(rings: str) -> str:
    """Every corner of every hole lies in or on an outer ring."""
    shells = f"filter({rings}, s_ -> {ring_area_sql('s_')} >= 0)"
    return (
        f"forall(filter({rings}, h_ -> {ring_area_sql('h_')} < 0), h_ ->"
        f" forall(h_, p_ -> {covers_sql(edges_sql(shells), 'p_.x', 'p_.y')}))"
    )


def nesting_ok_sql(rings: str) -> str:
    """Shells lie in an even number of other rings and holes in an odd number:
    no shell directly inside another, no hole inside a hole."""
    parity = f"(({ring_area_sql('r_')} < 0) = ({nesting_sql(rings, 'r_', 'i_')} % 2 = 1))"
    return f"forall(transform({rings}, (r_, i_) -> {parity}), ok_ -> ok_)"


def clashes_in_row_sql(edges: str) -> str:
    """Some pair of the numbered edges of one row clashes."""
    return (
        f"exists({edges}, e_ -> exists({edges}, f_ -> {later_sql('e_', 'f_')}"
        f" AND {clash_sql('e_', 'f_')}))"
    )


def shape_ok_sql(rings: str) -> str:
    """The part of validity that looks at rings one by one."""
    return (
        f"({closed_sql(rings)} AND (size({rings}) = 1"
        f" OR ({holes_inside_sql(rings)} AND {nesting_ok_sql(rings)})))"
    )


def is_valid(rings: str) -> Column:
    """Rings closed, simple and not crossing, holes inside an outer ring.

    Compares all edge pairs of one row, so it suits small polygons; a whole
    layer is checked by ``tidegrid.operators.validity.flag_valid``.
    """
    clean = clean_rings_sql(rings)
    return F.expr(
        f"coalesce({shape_ok_sql(clean)} AND NOT {clashes_in_row_sql(numbered_edges_sql(clean))}, false)"
    )


# -- reprojection ------------------------------------------------------------

# Fixed value: Web Mercator sphere radius in metres.
EARTH_RADIUS = 6378137


def mercator_sql(lon: str, lat: str) -> str:
    """lon/lat degrees to Mercator metres as struct<x,y>."""
    return (
        f"named_struct('x', radians({lon}) * {EARTH_RADIUS}D,"
        f" 'y', ln(tan(pi() / 4 + radians({lat}) / 2)) * {EARTH_RADIUS}D)"
    )


def mercator_xy(lon: str, lat: str) -> Column:
    return F.expr(mercator_sql(lon, lat))


def to_mercator(rings: str) -> Column:
    return F.expr(f"transform({rings}, r_ -> transform(r_, p_ -> {mercator_sql('p_.x', 'p_.y')}))")
