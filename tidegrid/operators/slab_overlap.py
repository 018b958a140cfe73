"""Large polygons against polygons, as sums over slabs.

The shared area of two polygons is a sum over pairs of directed edges and an
integral along x, so it may be added up slab by slab.  Every polygon is cut into
vertical slabs of a binary grid, finer where it has more edges; a crowded slab
that finer cuts cannot thin out, because its edges span it, is dealt into blocks
of edges.  The rows of two polygons meet where their slabs lie inside each other;
each meeting adds its part of the area and looks whether two of its edges touch.
Only sums and flags of pairs are shuffled after that, combined beforehand.

Whether a polygon without touching edges lies inside the other follows from the
first corner of each ring: the edges of the slab that holds it are enough for its
winding number along the vertical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.storage import written

# Edges of a row.
EDGES_A_SLAB = 256

_SPLIT = 3
_ROUNDS = 12
_KEY = ["__pid", "__lv", "__cx"]


def slab_table(shapes: DataFrame, geom: str, edges_a_slab: int = EDGES_A_SLAB) -> DataFrame:
    """__pid, __lv, __cx, __block, __edges: the edges that touch [__cx, __cx + 1] * 2**__lv along x.

    Slabs of a polygon do not overlap but for their sides.  A slab has several
    rows where more edges than ``edges_a_slab`` remain together.
    """
    extent = f"{geom}.xmax - {geom}.xmin"
    roots = shapes.selectExpr(
        "__pid", f"CASE WHEN {extent} > 0 THEN int(ceil(log2({extent}))) ELSE 0 END AS __lv",
        f"{geom}.xmin AS __xmin", f"{g.edges_sql(f'{geom}.rings')} AS __es",
    ).selectExpr("__pid", "__lv", "CAST(floor(__xmin / pow(2D, __lv)) AS BIGINT) AS __ox", "explode(__es) AS e")
    parts = []
    edges, k = roots, 2
    for round_no in range(_ROUNDS + 1):
        size = "pow(2D, __lv)"
        low = f"greatest(CAST(ceil(least(e.ax, e.bx) / {size}) AS BIGINT) - 1, __ox)"
        high = f"least(CAST(floor(greatest(e.ax, e.bx) / {size}) AS BIGINT), __ox + {k - 1})"
        touched = written(
            edges.selectExpr("__pid", "__lv", f"explode(sequence({low}, greatest({low}, {high}))) AS __cx", "e"), "slab-edges"
        )
        spanning = f"least(e.ax, e.bx) <= __cx * {size} AND greatest(e.ax, e.bx) >= (__cx + 1) * {size}"
        counts = touched.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("__n"), F.sum(F.expr(f"CASE WHEN {spanning} THEN 1 ELSE 0 END")).alias("__across")
        )
        # finer slabs are worth while as long as most edges end inside
        counts = written(
            counts.selectExpr(*_KEY, "__n", f"__n > {edges_a_slab} AND 2 * __across < __n AS __crowded"), "slab-counts"
        )
        last = round_no == _ROUNDS or counts.where("__crowded").isEmpty()
        done = counts if last else counts.where("NOT __crowded")
        block = f"CAST(pmod(xxhash64(e), CAST(ceil(__n / {edges_a_slab}D) AS BIGINT)) AS INT) AS __block"
        parts.append(
            touched.join(_unsent(done), _KEY)
            .selectExpr(*_KEY, block, "e")
            .groupBy(*_KEY, "__block")
            .agg(F.collect_list("e").alias("__edges"))
        )
        if last:
            break
        k = 1 << _SPLIT
        edges = touched.join(_unsent(counts.where("__crowded").select(*_KEY)), _KEY).selectExpr(
            "__pid", f"__lv - {_SPLIT} AS __lv", f"__cx * {k} AS __ox", "e"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return written(out, "slabs")


def _unsent(df: DataFrame) -> DataFrame:
    """Outlines and slabs take far more room in memory than on disk, so they are never sent to every executor."""
    return df.hint("merge")


def _tagged(slabs: DataFrame, tag: str) -> DataFrame:
    return slabs.withColumnsRenamed(
        {"__pid": f"__{tag}", "__lv": f"__lv_{tag}", "__cx": f"__cx_{tag}", "__block": f"__block_{tag}", "__edges": f"__e_{tag}"}
    )


def _levels(slabs: DataFrame, tag: str) -> DataFrame:
    """Levels of every polygon, at most a dozen."""
    return slabs.groupBy(F.col("__pid").alias(f"__{tag}")).agg(F.collect_set("__lv").alias(f"__levels_{tag}"))


def _meetings(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two polygons whose slabs lie inside each other, with the finer slab as [__lo, __hi]."""

    def finer(one: DataFrame, tag: str, other: DataFrame, to: str, test: str) -> DataFrame:
        lv, cx = f"__lv_{tag}", f"__cx_{tag}"
        return (
            pairs.join(_unsent(_levels(other, to)), f"__{to}")
            .join(_unsent(_tagged(one, tag)), f"__{tag}")
            .where(f"(__cx_{tag} + 1) * pow(2D, {lv}) >= __x0 AND __cx_{tag} * pow(2D, {lv}) <= __x1")
            .selectExpr("*", f"explode(filter(__levels_{to}, lv_ -> lv_ {test} {lv})) AS __lv_{to}")
            .drop(f"__levels_{to}")
            .selectExpr("*", f"shiftright({cx}, __lv_{to} - {lv}) AS __cx_{to}")
            .join(_unsent(_tagged(other, to)), [f"__{to}", f"__lv_{to}", f"__cx_{to}"])
            .selectExpr("*", f"{cx} * pow(2D, {lv}) AS __lo", f"({cx} + 1) * pow(2D, {lv}) AS __hi")
        )

    return finer(a, "a", b, "b", ">=").unionByName(finer(b, "b", a, "a", ">"))


def _starts_inside(pairs: DataFrame, starts: DataFrame, tag: str, slabs: DataFrame, to: str) -> DataFrame:
    """Pairs (__a, __b) in which a ring of the polygon ``tag`` starts inside or on the polygon ``to``.

    The winding number is that of a point a hair to the right, by the edges above it.
    """
    side = g.orient_sql("e_", "__x", "__y")
    above = (
        f"aggregate(__e_{to}, 0, (t_, e_) -> t_ + CASE"
        f" WHEN e_.ax <= __x AND e_.bx > __x AND {side} < 0 THEN -1"
        f" WHEN e_.bx <= __x AND e_.ax > __x AND {side} > 0 THEN 1 ELSE 0 END)"
    )
    return (
        pairs.select("__a", "__b")
        .join(_unsent(starts.withColumnRenamed("__pid", f"__{tag}")), f"__{tag}")
        .join(_unsent(_levels(slabs, to)), f"__{to}")
        .selectExpr("__a", "__b", "__ring", "__x", "__y", f"explode(__levels_{to}) AS __lv_{to}")
        .selectExpr("*", f"CAST(floor(__x / pow(2D, __lv_{to})) AS BIGINT) AS __cx_{to}")
        .join(_unsent(_tagged(slabs, to)), [f"__{to}", f"__lv_{to}", f"__cx_{to}"])
        .selectExpr("__a", "__b", "__ring", f"{above} AS __t", f"{g.on_boundary_sql(f'__e_{to}', '__x', '__y')} AS __on")
        .groupBy("__a", "__b", "__ring")
        .agg(F.sum("__t").alias("__t"), F.max("__on").alias("__on"))
        .where("__t <> 0 OR __on")
        .select("__a", "__b")
    )


def measured_pairs(
    pairs: DataFrame, a: DataFrame, b: DataFrame, a_geom: str, b_geom: str, edges_a_slab: int = EDGES_A_SLAB
) -> DataFrame:
    """__a, __b, shared, met for pairs (__a, __b) of polygons whose boxes meet.

    ``a`` and ``b`` have __pid and the geometry.  ``shared`` is the shared area,
    ``met`` tells whether they have any point in common.
    """

    def bounds(df, geom, tag):
        return df.selectExpr(f"__pid AS __{tag}", *[f"{geom}.{c} AS __{c}_{tag}" for c in g.BOUNDS])

    def taking_part(df, geom, tag):
        return df.join(_unsent(pairs.select(F.col(f"__{tag}").alias("__pid")).distinct()), "__pid", "left_semi").select("__pid", geom)

    def starts(df, geom):
        rings = df.selectExpr("__pid", f"posexplode({g.starts_sql(f'{geom}.rings')}) AS (__ring, __p)")
        return rings.selectExpr("__pid", "__ring", "__p.x AS __x", "__p.y AS __y")

    in_a, in_b = taking_part(a, a_geom, "a"), taking_part(b, b_geom, "b")
    slabs_a, slabs_b = slab_table(in_a, a_geom, edges_a_slab), slab_table(in_b, b_geom, edges_a_slab)
    boxed = pairs.join(_unsent(bounds(a, a_geom, "a")), "__a").join(_unsent(bounds(b, b_geom, "b")), "__b")
    boxed = boxed.selectExpr(
        "__a", "__b", "greatest(__xmin_a, __xmin_b) AS __x0", "least(__xmax_a, __xmax_b) AS __x1",
        "__ymin_a", "__ymax_a", "__ymin_b", "__ymax_b",
    )
    met = _meetings(boxed, slabs_a, slabs_b)
    lo, hi = "greatest(__x0, __lo)", "least(__x1, __hi)"
    sa = g.Shape("__e_a", None, lo, "__ymin_a", hi, "__ymax_a", "0D")
    sb = g.Shape("__e_b", None, lo, "__ymin_b", hi, "__ymax_b", "0D")
    parts = met.selectExpr(
        "__a", "__b", f"{g.overlap_sum_sql(sa, sb)} AS __shared", f"{g.edges_meet_sql(sa, sb)} AS __met"
    )
    inside = _starts_inside(pairs, starts(in_b, b_geom), "b", slabs_a, "a").unionByName(
        _starts_inside(pairs, starts(in_a, a_geom), "a", slabs_b, "b")
    )
    parts = parts.unionByName(inside.selectExpr("__a", "__b", "0D AS __shared", "true AS __met"))
    return parts.groupBy("__a", "__b").agg(
        F.greatest(F.sum("__shared"), F.lit(0.0)).alias("shared"), F.max("__met").alias("met")
    )
