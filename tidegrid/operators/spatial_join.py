"""Spatial joins as grid-keyed equi joins.

A predicate alone would plan as a nested loop over both layers.  Instead every
geometry gets cells of a grid whose cell size follows its own extent (a power
of two, so a box covers four cells at most), and the join runs on the cell key:

* each polygon sits in the cells of its own level;
* it also sits in the coarser levels that the *other* layer really uses, so a
  pair meets on exactly one level, that of the larger partner;
* a pair sharing several cells is kept only in the cell that holds the lower
  left corner of the common box, so no de-duplicating shuffle is needed.

The levels in use and the extent of each layer are read beforehand by one small
job over the bounds columns (two result rows).  Each extent becomes a filter on the
other layer's bounds, which the parquet scan uses to skip row groups of a layer
stored by place (the "one state only" filter, without being told the state).
Catalyst then picks broadcast or sort-merge by size, unless both sides are too large for a
broadcast: it only knows their size on disk, where outlines take a small share of the room they
need in memory, once per cell.  Rows per cell are counted from the
bounds alone, and a cell that would hold too much work is split into blocks
(see ``_split_hot_cells``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.storage import written
from .cell_cover import cell_cover, point_in_cell_sql
from .copies import code, located, once
from .slab_overlap import measured_pairs

# Level of a point: finer than any polygon, so points never own a cell.
_POINT_LEVEL = -200

# Level of shapes without extent where they have to own a cell (coincident
# points, collapsed polygons).
_SPOT_LEVEL = -20

# Rows per block when a hot cell is split.
BLOCK_ROWS = 20_000

# Polygons with more corners are cut per cell.
CUT_CORNERS = 1_000

# A cell with more blocks than this on one side is split whatever the other side holds.
FEW_BLOCKS = 4

# Memory that a row and a corner of its outline take in a join, and the most that is broadcast.
ROW_BYTES, CORNER_BYTES = 256, 80
BROADCAST_BYTES = 10 << 20

_CELL = ("__owner_level", "__cx", "__cy")

SYMMETRIC = {"intersects", "overlaps", "touches", "equals"}
POLYGON_PREDICATES = SYMMETRIC | {"contains", "within"}


class _Side:
    """One input: its DataFrame plus internal bounds and shape columns.

    ``grow`` widens the bounds, ``tag`` (a or b) names the internal columns.
    """

    def __init__(self, df: DataFrame, geom, tag: str, grow: float | None = None, layer=None):
        self.tag, self.geom, self.grow = tag, geom, grow
        self.is_point = not isinstance(geom, str)
        self.has_extent = grow is not None or not self.is_point
        self.df, self.columns = df, df.columns
        x0, y0, x1, y1 = (
            [*geom, *geom] if self.is_point else [f"{geom}.{c}" for c in g.BOUNDS]
        )
        if grow:
            x0, y0, x1, y1 = (f"({v} {op} {grow!r}D)" for v, op in zip((x0, y0, x1, y1), "--++"))
        self.bounds = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
        self.source = df.where(f"{x0} IS NOT NULL AND {y0} IS NOT NULL")
        self.layer = df if layer is None else layer
        self.shape = g.Shape(*[self.name(k) for k in ("edges", "starts", "x0", "y0", "x1", "y1", "area")])

    def name(self, part: str) -> str:
        return f"__{self.tag}_{part}"

    @property
    def level(self) -> str:
        if not self.has_extent:
            return str(_POINT_LEVEL)
        b = self.bounds
        extent = f"greatest({b['x1']} - {b['x0']}, {b['y1']} - {b['y0']})"
        return f"CASE WHEN {extent} > 0 THEN int(ceil(log2({extent}))) ELSE {_SPOT_LEVEL} END"

    @property
    def corners(self) -> str:
        """Corners of a row's polygon; they are part of the geometry where the library made it."""
        if self.is_point:
            return "0"
        fields = self.layer.schema[self.geom].dataType.names
        return f"{self.geom}.corners" if "corners" in fields else g.corners_sql(f"{self.geom}.rings")

    def summary(self) -> DataFrame:
        """Levels in use, extent and number of rows and corners, as one row.

        Both may come from a larger layer: more levels or a wider extent cost a
        little work and never change the result.
        """
        b = self.bounds
        return self.layer.selectExpr(
            f"'{self.tag}' AS tag", f"collect_set({self.level}) AS levels", "count(1) AS n",
            f"max({self.corners}) AS corners", f"sum({self.corners}) AS all_corners",
            f"CAST(min({b['x0']}) AS DOUBLE) AS x0", f"CAST(min({b['y0']}) AS DOUBLE) AS y0",
            f"CAST(max({b['x1']}) AS DOUBLE) AS x1", f"CAST(max({b['y1']}) AS DOUBLE) AS y1",
        )

    def room(self, own: Row) -> int:
        """Bytes that the rows take in memory, once per cell; ``own`` is the summary."""
        cells = 4 if self.has_extent else 1
        return cells * (own["n"] * ROW_BYTES + (own["all_corners"] or 0) * CORNER_BYTES)

    def bounds_only(self) -> _Side:
        """The same side over nothing but what its bounds are read from.

        A larger layer given for the summary stands in for the rows of a join.
        """
        columns = list(self.geom) if self.is_point else [self.geom]
        return _Side(self.layer.select(*columns), self.geom, self.tag, self.grow)

    def inside(self, other: Row) -> Column:
        """The bounds meet the extent of the other layer."""
        b = self.bounds
        return (
            (F.expr(b["x0"]) <= F.lit(other["x1"])) & (F.expr(b["x1"]) >= F.lit(other["x0"]))
            & (F.expr(b["y0"]) <= F.lit(other["y1"])) & (F.expr(b["y1"]) >= F.lit(other["y0"]))
        )

    def in_cells(self, other: Row, owner: int, rows_only: bool = False, with_corners: bool = False) -> DataFrame:
        """Rows inside the other layer's extent, once per cell.

        ``owner`` is 0 for the left side and 1 for the right; the coarser
        partner of a pair owns the cell, the left side on a tie.  With
        ``rows_only`` just the cells come out, without the columns; with
        ``with_corners`` the number of corners is among them.
        """
        b = self.bounds
        levels = sorted(lv for lv in other["levels"] if lv > _POINT_LEVEL)
        foreign = f"CAST(array({', '.join(map(str, levels))}) AS ARRAY<INT>)"
        parts = [f"{v} AS {self.name(k)}" for k, v in b.items()]
        parts.append(f"{self.level} AS {self.name('level')}")
        if not (self.is_point or rows_only):
            parts.append(f"{g.edges_sql(f'{self.geom}.rings')} AS {self.name('edges')}")
            parts.append(f"{g.starts_sql(f'{self.geom}.rings')} AS {self.name('starts')}")
            parts.append(f"{g.polygon_area_sql(self.geom)} AS {self.name('area')}")
            if with_corners:
                parts.append(f"{self.corners} AS {self.name('corners')}")
        rows = self.source.where(self.inside(other)).selectExpr("*", *parts)
        level = self.name("level")
        coarser = f"lv_ > {level}" if owner == 0 else f"lv_ >= {level}"
        cells = (
            f"flatten(transform(filter({foreign}, lv_ -> {coarser}),"
            f" lv_ -> {self._cells('lv_', 1 - owner)}))"
        )
        if self.has_extent:
            own = f"transform(filter(array({level}), lv_ -> lv_ > {_POINT_LEVEL}), lv_ -> {self._cells('lv_', owner)})"
            cells = f"concat(flatten({own}), {cells})"
        if rows_only:
            return rows.selectExpr(f"inline({cells})")
        kept = [*self.columns, *[self.name(k) for k in b]]
        if not self.is_point:
            kept += [self.name("edges"), self.name("starts"), self.name("area")]
            if with_corners:
                kept.append(self.name("corners"))
        return rows.selectExpr(*[f"`{c}`" for c in kept], f"inline({cells})")

    def _cells(self, level: str, owner: int) -> str:
        size = f"pow(2D, {level})"
        x0, y0, x1, y1 = (f"floor({self.name(k)} / {size})" for k in ("x0", "y0", "x1", "y1"))
        return (
            f"flatten(transform(sequence({x0}, {x1}), cx_ -> transform(sequence({y0}, {y1}), cy_ ->"
            f" named_struct('__owner_level', int({level} * 2 + {owner}), '__cx', cx_, '__cy', cy_))))"
        )


def _boxes(a: _Side, b: _Side) -> str:
    """Bounds meet, and this cell is the one that reports the pair."""
    meet = g.boxes_meet_sql(a.shape, b.shape)
    if a.has_extent and b.has_extent:
        size = "pow(2D, shiftright(__owner_level, 1))"
        meet += (
            f" AND floor(greatest({a.shape.xmin}, {b.shape.xmin}) / {size}) = __cx"
            f" AND floor(greatest({a.shape.ymin}, {b.shape.ymin}) / {size}) = __cy"
        )
    return meet


def _exact(predicate: str, a: _Side, b: _Side) -> str:
    if a.is_point and b.is_point:
        raise ValueError("use distance_join for two point layers")
    if not (a.is_point or b.is_point):
        return g.predicate_sql(predicate, a.shape, b.shape)
    point, area = (a, b) if a.is_point else (b, a)
    operands = area.shape.edges, point.shape.xmin, point.shape.ymin
    if predicate == ("within" if a.is_point else "contains"):
        return g.contains_sql(*operands)
    if predicate == "intersects":
        return g.covers_sql(*operands)
    if predicate == "touches":
        return g.on_boundary_sql(*operands)
    # a point is never equal to, overlapping, or a container of an area
    return "false"


def _hot_cells(left_cells: DataFrame, right_cells: DataFrame, block_rows: int) -> DataFrame:
    """Cells with too many candidate pairs, or too many rows of one side alone, and into how many blocks each side is
    cut there.

    Only cells go in, without geometry; rows are counted before the shuffle.
    """
    per_cell = left_cells.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("__na")).join(
        right_cells.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("__nb")), list(_CELL)
    )
    work = F.col("__na").cast("double") * F.col("__nb")
    crowd = F.greatest("__na", "__nb")
    return per_cell.where((work > float(block_rows) * block_rows) | (crowd > FEW_BLOCKS * block_rows)).select(
        *_CELL,
        F.ceil(F.col("__na") / block_rows).alias("__blocks_a"),
        F.ceil(F.col("__nb") / block_rows).alias("__blocks_b"),
    )


def _split_hot_cells(left: DataFrame, right: DataFrame, hot: DataFrame):
    """Divide hot cells into blocks.

    A left row of a hot cell picks one of the left blocks by its row number and
    is repeated for every right block, and the other way round, so each pair
    meets exactly once, no task has to take a whole hot cell, and copies of one
    row spread like other rows.  Every hot cell is split; the planner joins their
    list by size.
    """

    def spread(df, mine, theirs):
        blocks = F.coalesce(F.col(f"__blocks_{mine}"), F.lit(1))
        others = F.coalesce(F.col(f"__blocks_{theirs}"), F.lit(1))
        return (
            df.withColumn("__row", F.monotonically_increasing_id())
            .join(hot, list(_CELL), "left")
            .withColumn(f"__block_{mine}", F.pmod(F.xxhash64("__row"), blocks))
            .withColumn(f"__block_{theirs}", F.explode(F.sequence(F.lit(0), others - 1)))
            .drop("__blocks_a", "__blocks_b", "__row")
        )

    return spread(left, "a", "b"), spread(right, "b", "a")


def _summaries(a: _Side, b: _Side) -> dict[str, Row]:
    """Both summaries, read in one small job."""
    return {row["tag"]: row for row in a.summary().unionAll(b.summary()).collect()}


def _candidates(a: _Side, b: _Side, summary, partition_keys, split_hot, block_rows, with_corners=False):
    """Both sides in cells, and the names of the equi-join columns.

    The two summaries have been read by now, so that the extents reach the scans
    as plain filters; a second job over the bounds columns looks whether any
    cell is hot.
    """
    left = a.in_cells(summary["b"], 0, with_corners=with_corners)
    right = b.in_cells(summary["a"], 1, with_corners=with_corners)
    keys = list(_CELL)
    for i, (ka, kb) in enumerate(partition_keys):
        left = left.withColumn(f"__key{i}", F.col(ka))
        right = right.withColumn(f"__key{i}", F.col(kb))
        keys.append(f"__key{i}")
    # with so few rows no cell can be hot, and nothing needs to be counted
    n = [summary[tag]["n"] for tag in "ab"]
    few = n[0] * n[1] <= block_rows * block_rows and max(n) <= FEW_BLOCKS * block_rows
    if split_hot or (split_hot is None and not few):
        hot = _hot_cells(
            a.bounds_only().in_cells(summary["b"], 0, True),
            b.bounds_only().in_cells(summary["a"], 1, True),
            block_rows,
        )
        if split_hot or not hot.isEmpty():
            left, right = _split_hot_cells(left, right, hot)
            keys += ["__block_a", "__block_b"]
    if min(a.room(summary["a"]), b.room(summary["b"])) > BROADCAST_BYTES:
        left = left.hint("merge")
    return left, right, keys


def _joined(left, right, keys, condition, how):
    renamed = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    equal = " AND ".join(f"{k} = {k}_r" for k in keys)
    return left.join(renamed, F.expr(f"{equal} AND {condition}"), how)


def spatial_join(
    a: DataFrame,
    b: DataFrame,
    predicate: str,
    how: str = "inner",
    *,
    a_geom="geometry",
    b_geom="geometry",
    partition_keys: Sequence[tuple[str, str]] = (),
    left_key: Sequence[str] | str | None = None,
    overlap_area: str | None = None,
    a_layer: DataFrame | None = None,
    b_layer: DataFrame | None = None,
    split_hot: bool | None = None,
    block_rows: int = BLOCK_ROWS,
    cut_corners: int = CUT_CORNERS,
    copies_once: bool = False,
) -> DataFrame:
    """Join two layers where ``predicate(a, b)`` holds.

    predicate       contains, within, intersects, overlaps, touches or equals
    how             inner, left_semi or left_anti
    a_geom, b_geom  name of a geometry column, or (lon, lat) names of a point
    partition_keys  (a column, b column) pairs that must also be equal
    left_key        columns that identify a row's geometry in ``a``; needed for
                    semi/anti joins of polygons (points use their coordinates);
                    these joins see every different geometry once
    overlap_area    name of an extra column holding area(a and b) (inner only)
    a_layer, b_layer  for an input that is itself the result of joins: a plain
                    layer that holds all its geometries, to read the grid levels
                    and extent from without running those joins twice
    split_hot       split crowded cells: None looks whether there are any, True
                    splits without looking first, False never splits
    cut_corners     polygons with more corners are cut per cell (``cell_cover``)
    copies_once     compare every different geometry once and make the pairs of rows
                    from that, where a layer holds many copies (inner only)
    """
    if predicate not in POLYGON_PREDICATES:
        raise ValueError(f"unknown spatial predicate {predicate!r}")
    if how == "inner":
        clash = set(a.columns) & set(b.columns)
        if clash:
            raise ValueError(f"rename columns present on both sides: {sorted(clash)}")
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    if how != "inner":
        if left_key is None and isinstance(a_geom, str):
            raise ValueError("left_key is needed for semi and anti joins of polygons")
        limits = {"split_hot": split_hot, "block_rows": block_rows, "cut_corners": cut_corners}
        return _with_match(a, b, predicate, how, a_geom, b_geom, partition_keys, left_key, limits)
    if copies_once:
        limits = {"split_hot": split_hot, "block_rows": block_rows, "cut_corners": cut_corners}
        return _pairs_of_rows(a, b, predicate, a_geom, b_geom, partition_keys, overlap_area, limits)
    sa = _Side(a, a_geom, "a", layer=a_layer)
    sb = _Side(b, b_geom, "b", layer=b_layer)
    summary = _summaries(sa, sb)
    out = [F.col(c) for c in (*a.columns, *b.columns)]
    cut = None
    if sa.is_point != sb.is_point and max(summary[t]["corners"] or 0 for t in "ab") > cut_corners:
        # large outlines go cell by cell, the others as whole rows
        area = sb if sa.is_point else sa
        large = F.expr(f"{area.corners} > {cut_corners}")
        cut = _cut_pairs(sa, sb, large, predicate, partition_keys, block_rows, summary)
        rest = area.df.where(~large)
        if area is sa:
            sa = _Side(rest, a_geom, "a", layer=sa.layer)
        else:
            sb = _Side(rest, b_geom, "b", layer=sb.layer)
    whole = "true"
    if not (sa.is_point or sb.is_point) and max(summary[t]["corners"] or 0 for t in "ab") > cut_corners:
        # pairs with a large outline are measured slab by slab, the others as whole rows
        cut = _slab_pairs(sa, sb, summary, predicate, partition_keys, split_hot, block_rows, cut_corners, overlap_area)
        whole = f"{sa.name('corners')} <= {cut_corners} AND {sb.name('corners')} <= {cut_corners}"
    left, right, keys = _candidates(sa, sb, summary, partition_keys, split_hot, block_rows, with_corners=whole != "true")
    boxes = f"{whole} AND {_boxes(sa, sb)}"
    condition = f"{boxes} AND {_exact(predicate, sa, sb)}"
    if overlap_area is not None and (sa.is_point or sb.is_point):
        raise ValueError("a point and an area share no area")
    if overlap_area is None:
        pairs = _joined(left, right, keys, condition, "inner").select(*out)
        return pairs if cut is None else pairs.unionByName(cut.select(*out))
    # the measure comes with the predicate, so both are worked out in one go
    areas = g.areas_sql(sa.shape, sb.shape)
    test = g.area_test_sql(predicate, "o_") if predicate != "intersects" else "true"
    rest = _exact("intersects", sa, sb) if predicate in ("intersects", "touches") else "true"
    pairs = _joined(left, right, keys, f"{boxes} AND {rest}", "inner")
    measured = pairs.selectExpr("*", f"inline(filter(array({areas}), o_ -> {test}))")
    measured = measured.select(*out, F.col("shared").alias(overlap_area))
    return measured if cut is None else measured.unionByName(cut.select(*out, overlap_area))


# -- every geometry once ---------------------------------------------------------

def _sides_once(a, b, a_geom, b_geom, partition_keys, radius: float | None = None):
    """Both sides with every geometry (and partition key) once, the keyword arguments that join them, and by what the
    rows of ``a`` are found again.

    The extent of the left side filters the right one before its copies are brought together.  Of the right side only
    internal columns take part, so its names may be those of the left.
    """
    keys_a = list(dict.fromkeys(ka for ka, _ in partition_keys))
    # the columns take other names first, so that a key may be a coordinate too
    theirs = [b_geom] if isinstance(b_geom, str) else list(b_geom)
    shape_b = [f"__other{i}" for i in range(len(theirs))]
    keys_b = [f"__other_key{i}" for i in range(len(partition_keys))]
    right = b.select(
        *[F.col(c).alias(n) for c, n in zip(theirs, shape_b)],
        *[F.col(kb).alias(n) for (_, kb), n in zip(partition_keys, keys_b)],
    )
    geom_b = shape_b[0] if isinstance(b_geom, str) else tuple(shape_b)
    left = once(a, a_geom, keys_a, "__rows")
    extent = _Side(left, a_geom, "a", radius).summary().first()
    right = once(right.where(_Side(right, geom_b, "b").inside(extent)), geom_b, keys_b, "__n")
    left = left.withColumns(code(a_geom))
    by = [*code(a_geom), *keys_a]
    joined = {"a_geom": a_geom, "b_geom": geom_b}
    return left, right, {**joined, "partition_keys": [(ka, n) for (ka, _), n in zip(partition_keys, keys_b)]}, by


def _with_match(a, b, predicate, how, a_geom, b_geom, partition_keys, left_key, limits) -> DataFrame:
    """Rows of ``a`` whose key has, or has not, a geometry for which the predicate holds with any of ``b``."""
    left, right, joined, by = _sides_once(a, b, a_geom, b_geom, partition_keys)
    matched = spatial_join(left, right, predicate, **joined, **limits).select(*by).distinct()
    coded = a.withColumns(code(a_geom))
    if left_key is None:
        return coded.join(matched, by, how).select(*a.columns)
    # the keys that had to be equal are part of what a match is about
    columns = list(dict.fromkeys([*([left_key] if isinstance(left_key, str) else left_key), *[ka for ka, _ in partition_keys]]))
    # The planner streams the large side past the small one, and only distinct keys leave each task.
    found = coded.join(matched, by, "left_semi").select(*columns).distinct()
    return a.join(found, columns, how).select(*a.columns)


def _pairs_of_rows(a, b, predicate, a_geom, b_geom, partition_keys, overlap_area, limits) -> DataFrame:
    """Pairs of rows made from the pairs of their geometries.

    Rows of either side go to the pairs their geometry is part of, those of a crowded geometry in blocks as in
    ``_split_hot_cells``, so no task has to take more than a block of either side at once.  Nothing is broadcast.
    """
    left, right, joined, by_a = _sides_once(a, b, a_geom, b_geom, partition_keys)
    codes_b = {f"__to{i}": c for i, c in enumerate(code(joined["b_geom"]).values())}
    keys_b = {n: F.col(kb) for (_, kb), (_, n) in zip(partition_keys, joined["partition_keys"])}
    by_b = [*codes_b, *keys_b]
    measure = [] if overlap_area is None else ["__shared"]
    met = spatial_join(
        left, right.withColumns(codes_b), predicate, **joined, overlap_area=measure[0] if measure else None, **limits
    )
    met = written(
        met.select(
            *by_a, *by_b, *measure,
            F.ceil(F.col("__rows") / limits["block_rows"]).alias("__blocks_a"),
            F.ceil(F.col("__n") / limits["block_rows"]).alias("__blocks_b"),
            F.monotonically_increasing_id().alias("__pair"),
        ),
        "met-outlines",
    )
    join_on = ["__pair", "__block_a", "__block_b"]

    def spread(rows, by, columns, mine, theirs):
        return (
            rows.withColumn("__row", F.monotonically_increasing_id())
            .join(met.select(*by, "__pair", "__blocks_a", "__blocks_b", *measure).hint("merge"), by)
            .withColumn(f"__block_{mine}", F.pmod(F.xxhash64("__row"), F.col(f"__blocks_{mine}")))
            .withColumn(f"__block_{theirs}", F.explode(F.sequence(F.lit(0), F.col(f"__blocks_{theirs}") - 1)))
            .select(*columns, *join_on)
        )

    rows_a = located(a, a_geom).withColumns(code(a_geom))
    rows_b = located(b, b_geom).withColumns({n: c for n, c in zip(codes_b, code(b_geom).values())} | keys_b)
    pairs = spread(rows_a, by_a, [*a.columns, *measure], "a", "b").join(
        spread(rows_b, by_b, b.columns, "b", "a").hint("merge"), join_on
    )
    return pairs.select(*a.columns, *b.columns, *[F.col(c).alias(overlap_area) for c in measure])


def partner_counts(
    a: DataFrame,
    b: DataFrame,
    predicate: str,
    *,
    a_geom="geometry",
    b_geom="geometry",
    count: str = "n_partners",
    overlap_area: str | None = None,
    partition_keys: Sequence[tuple[str, str]] = (),
    cut_corners: int = CUT_CORNERS,
) -> DataFrame:
    """Rows of ``a`` that have partners in ``b``, with their number and, on request, the summed shared area.

    What ``spatial_join`` gives after grouping by the left row, but copies of a
    geometry go through the join once on either side, so the pairs grow with the
    different geometries only.
    """
    left, right, joined, by = _sides_once(a, b, a_geom, b_geom, partition_keys)
    pairs = spatial_join(left, right, predicate, **joined, overlap_area=overlap_area and "__shared", cut_corners=cut_corners)
    measures = [F.sum("__n").alias(count)]
    if overlap_area is not None:
        measures.append(F.sum(F.col("__shared") * F.col("__n")).alias(overlap_area))
    return _given_back(a, a_geom, pairs, by, measures)


def near_counts(
    a: DataFrame,
    b: DataFrame,
    radius: float,
    *,
    a_geom="geometry",
    b_geom="geometry",
    count: str = "n_near",
    nearest: str = "nearest",
    total: str = "total_distance",
) -> DataFrame:
    """Rows of ``a`` with anything of ``b`` no further than ``radius``: how much, the least and the summed distance.

    ``distance_join`` grouped by the left row, every geometry seen once.
    """
    left, right, joined, by = _sides_once(a, b, a_geom, b_geom, (), radius)
    pairs = distance_join(left, right, radius, distance="__distance", **joined)
    measures = [
        F.sum("__n").alias(count), F.min("__distance").alias(nearest),
        F.sum(F.col("__distance") * F.col("__n")).alias(total),
    ]
    return _given_back(a, a_geom, pairs, by, measures)


def _given_back(a: DataFrame, a_geom, pairs: DataFrame, by: list[str], measures) -> DataFrame:
    """Measures of the pairs of a geometry, at every row that has it."""
    sums = pairs.groupBy(*by).agg(*measures)
    names = [c for c in sums.columns if c not in by]
    return a.withColumns(code(a_geom)).join(sums, by).select(*a.columns, *names)


def _cut_pairs(sa: _Side, sb: _Side, large, predicate, partition_keys, block_rows, summary) -> DataFrame:
    """Pairs of points and large polygons, over the cells of the polygons (see ``cell_cover``).

    Every point visits its cell on each level that occurs and meets the one cover row of a polygon there, if any.
    Only numbers of polygons go through that join; their columns are fetched for the pairs at the end, so an outline
    is read only if the caller wants it.
    """
    points, area = (sa, sb) if sa.is_point else (sb, sa)
    rows = written(area.df.where(large).withColumn("__pid", F.monotonically_increasing_id()), "large-polygons")
    cover = cell_cover(rows.select("__pid", area.geom), area.geom)
    levels = sorted(r["__lv"] for r in cover.select("__lv").distinct().collect())  # at most some dozens
    x, y = points.geom
    keys = [(f"__k{i}", ka, kb) if points is sa else (f"__k{i}", kb, ka) for i, (ka, kb) in enumerate(partition_keys)]
    cells = ", ".join(
        f"named_struct('__owner_level', {lv}, '__cx', CAST(floor({x} / pow(2D, {lv})) AS BIGINT),"
        f" '__cy', CAST(floor({y} / pow(2D, {lv})) AS BIGINT))"
        for lv in levels
    )
    visiting = points.source.select(
        *[F.col(c).alias(f"__p_{c}") for c in points.columns],
        F.expr(f"CAST({x} AS DOUBLE)").alias("__x"), F.expr(f"CAST({y} AS DOUBLE)").alias("__y"),
        *[F.col(c).alias(k) for k, c, _ in keys],
        F.expr(f"inline(array({cells}))" if levels else "inline(CAST(array() AS ARRAY<STRUCT<__owner_level: INT, __cx: BIGINT, __cy: BIGINT>>))"),
    )
    placed = cover.withColumnRenamed("__lv", "__owner_level")
    if keys:
        placed = placed.join(rows.select("__pid", *[F.col(c).alias(f"{k}_r") for k, _, c in keys]), "__pid")
    join_on = list(_CELL)
    if summary[points.tag]["n"] > FEW_BLOCKS * block_rows:
        hot = _hot_cells(visiting.select(*_CELL), placed.select(*_CELL), block_rows)
        if not hot.isEmpty():
            visiting, placed = _split_hot_cells(visiting, placed, hot)
            join_on += ["__block_a", "__block_b"]
    # the right and upper sides of cells belong to their neighbours, so a point is in one cell of a polygon only
    test = point_in_cell_sql({"within": "contains"}.get(predicate, predicate), "__x", "__y").replace("__lv", "__owner_level")
    right_way = predicate in ("intersects", "touches") or predicate == ("within" if points is sa else "contains")
    same = " AND ".join(["true", *[f"{k} = {k}_r" for k, *_ in keys]])
    met = visiting.join(placed, join_on).where(f"{str(right_way).lower()} AND {same} AND {test}")
    met = met.select("__pid", *[f"__p_{c}" for c in points.columns])
    attributes = rows.select("__pid", *[F.col(c).alias(f"__g_{c}") for c in area.columns])
    both = [F.col(f"__p_{c}").alias(c) for c in points.columns]
    both += [F.col(f"__g_{c}").alias(c) for c in area.columns]
    return met.join(attributes, "__pid").select(*both)


def _slab_pairs(
    sa: _Side, sb: _Side, summary, predicate, partition_keys, split_hot, block_rows, cut_corners, overlap_area
) -> DataFrame:
    """Pairs of polygons of which one or both are large, measured slab by slab (see ``slab_overlap``).

    Candidates are found by their boxes, as numbers only; the columns of the
    polygons are fetched for the pairs at the end.
    """

    def staged(side: _Side, tag: str) -> tuple[DataFrame, _Side]:
        numbered = side.df.withColumns({"__pid": F.monotonically_increasing_id(), "__area": g.polygon_area(side.geom)})
        rows = written(numbered, "polygons")
        slim = rows.select("__pid", F.col(side.geom).alias("__geom"), *[F.col(c).alias(f"__k{i}") for i, c in keys[tag]])
        slim = slim.withColumnsRenamed({c: f"{c}_{tag}" for c in slim.columns})
        return rows, _Side(slim, f"__geom_{tag}", tag)

    keys = {
        "a": [(i, ka) for i, (ka, _) in enumerate(partition_keys)],
        "b": [(i, kb) for i, (_, kb) in enumerate(partition_keys)],
    }
    (rows_a, a), (rows_b, b) = staged(sa, "a"), staged(sb, "b")
    equal = [(f"__k{i}_a", f"__k{i}_b") for i, _ in keys["a"]]
    left, right, join_on = _candidates(a, b, summary, equal, split_hot, block_rows, with_corners=True)
    large = f"({a.name('corners')} > {cut_corners} OR {b.name('corners')} > {cut_corners})"
    pairs = _joined(left, right, join_on, f"{large} AND {_boxes(a, b)}", "inner")
    pairs = written(pairs.select(F.col("__pid_a").alias("__a"), F.col("__pid_b").alias("__b")), "pairs")
    measured = measured_pairs(pairs, rows_a, rows_b, sa.geom, sb.geom)
    measured = measured.withColumnsRenamed({"shared": "__shared", "met": "__met"})
    areas = "named_struct('shared', __shared, 'a', __area_a, 'b', __area_b)"
    test = "__met" if predicate == "intersects" else g.area_test_sql(predicate, areas)
    if predicate == "touches":
        test = f"__met AND {test}"

    def fetched(rows: DataFrame, side: _Side, tag: str) -> DataFrame:
        return rows.select(F.col("__pid").alias(f"__{tag}"), F.col("__area").alias(f"__area_{tag}"), *side.columns)

    # by merging, since outlines take far more room in memory than on disk
    found = measured.join(fetched(rows_a, sa, "a").hint("merge"), "__a").join(fetched(rows_b, sb, "b").hint("merge"), "__b").where(test)
    return found if overlap_area is None else found.withColumnRenamed("__shared", overlap_area)


def distance_join(
    a: DataFrame,
    b: DataFrame,
    radius: float,
    *,
    a_geom="geometry",
    b_geom="geometry",
    distance: str = "distance",
    partition_keys: Sequence[tuple[str, str]] = (),
    split_hot: bool | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs no further apart than ``radius``, with their distance.

    The left bounds grow by the radius and go through the same grid.
    """
    clash = set(a.columns) & set(b.columns)
    if clash:
        raise ValueError(f"rename columns present on both sides: {sorted(clash)}")
    sa, sb = _Side(a, a_geom, "a", grow=radius), _Side(b, b_geom, "b")
    left, right, keys = _candidates(sa, sb, _summaries(sa, sb), partition_keys, split_hot, block_rows)
    if sa.is_point and sb.is_point:
        far = g.point_distance_sql(*a_geom, *b_geom)
    elif sa.is_point:
        far = g.point_polygon_distance_sql(sb.shape.edges, *a_geom)
    elif sb.is_point:
        far = g.point_polygon_distance_sql(sa.shape.edges, *b_geom)
    else:
        # the bounds kept for the grid are widened, the measure needs the real ones
        own = g.Shape(sa.shape.edges, sa.shape.starts, *[f"{a_geom}.{c}" for c in g.BOUNDS])
        far = g.distance_sql(own, sb.shape)
    pairs = _joined(left, right, keys, _boxes(sa, sb), "inner")
    return (
        pairs.withColumn("__far", F.expr(far))
        .where(F.col("__far") <= radius)
        .select(*a.columns, *b.columns, F.col("__far").alias(distance))
    )


def with_overlap_area(
    pairs: DataFrame, a_geom: str, b_geom: str, name: str = "overlap_area"
) -> DataFrame:
    """Add area(a and b) to rows that carry both geometries."""
    return pairs.withColumn(name, g.intersection_area(a_geom, b_geom))
