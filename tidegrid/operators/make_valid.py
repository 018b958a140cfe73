"""Repair of outlines that cross themselves, by the even-odd rule.

Edges of an outline that meet are found on the grid of the validity check and cut
at the places where they do, all with built-in expressions.  The cut edges of one
outline are then traced into rings by a small helper: a stretch that an even
number of edges run along bounds nothing; the others part the plane into faces,
inside and outside take turns across them, and the outlines of the inside faces
are the rings.  A bow-tie becomes two triangles, a ring that doubles back loses
the spike, and rings that overlap leave their common part out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.storage import written
from .validity import _CELL, _edge_rows, repaired_rings_sql, with_geometry

_OUTLINE = ["__outline_a", "__outline_b"]


def _meeting_points_sql(e: str, f: str) -> str:
    """array<struct<own, x, y>>: where edge ``e`` (own) or ``f`` (not own) has to be cut because they meet.

    A crossing is worked out once for both; an end on the other edge is taken as it is.
    """

    def on(edge, x, y):
        return (
            f"({g.orient_sql(edge, x, y)} = 0 AND {x} BETWEEN least({edge}.ax, {edge}.bx) AND greatest({edge}.ax, {edge}.bx)"
            f" AND {y} BETWEEN least({edge}.ay, {edge}.by) AND greatest({edge}.ay, {edge}.by))"
        )

    ends = ", ".join(
        f"CASE WHEN {on(edge, f'{end}.{i}x', f'{end}.{i}y')} THEN named_struct('own', {own}, 'x', {end}.{i}x, 'y', {end}.{i}y) END"
        for edge, end, own in ((f, e, "false"), (e, f, "true"))
        for i in "ab"
    )
    o1, o2 = g.orient_sql(f, f"{e}.ax", f"{e}.ay"), g.orient_sql(f, f"{e}.bx", f"{e}.by")
    o3, o4 = g.orient_sql(e, f"{f}.ax", f"{f}.ay"), g.orient_sql(e, f"{f}.bx", f"{f}.by")
    t = f"({o1} / ({o1} - {o2}))"
    point = f"'x', {e}.ax + {t} * ({e}.bx - {e}.ax), 'y', {e}.ay + {t} * ({e}.by - {e}.ay)"
    crossing = f"array(named_struct('own', true, {point}), named_struct('own', false, {point}))"
    return (
        f"CASE WHEN signum({o1}) * signum({o2}) < 0 AND signum({o3}) * signum({o4}) < 0 THEN {crossing}"
        f" ELSE filter(array({ends}), c_ -> c_ IS NOT NULL) END"
    )


def noded_edges(shapes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Edges of every outline, cut wherever two of them meet: the key, ax, ay, bx, by.

    ``shapes`` has the key and numbered edges ``__es``.  Each pair of edges is
    looked at on the grid level of the longer one, so a long outline is spread
    over many tasks.
    """
    key = list(key)
    rows = _edge_rows(shapes, key)
    others = rows.withColumnsRenamed({"__edge": "__other", "__own": "__other_own"})
    cuts = (
        rows.join(others, [*key, *_CELL])
        .where(f"__own AND ({g.later_sql('__edge', '__other')} OR NOT __other_own) AND {g.segments_meet_sql('__edge', '__other')}")
        .selectExpr(*key, "__edge", "__other", f"inline({_meeting_points_sql('__edge', '__other')})")
        .selectExpr(*key, "CASE WHEN own THEN __edge ELSE __other END AS e", "named_struct('x', x, 'y', y) AS p")
        .groupBy(*key, F.expr("e.ring").alias("ring"), F.expr("e.pos").alias("pos"))
        .agg(F.collect_set("p").alias("__cuts"))
    )
    along = "(p_.x - ax) * (bx - ax) + (p_.y - ay) * (by - ay)"
    ordered = f"transform(array_sort(transform(__cuts, p_ -> named_struct('t', {along}, 'x', p_.x, 'y', p_.y))), p_ -> named_struct('x', p_.x, 'y', p_.y))"
    return (
        shapes.selectExpr(*key, "inline(__es)")
        .join(cuts, [*key, "ring", "pos"], "left")
        .selectExpr(
            *key,
            f"concat(array(named_struct('x', ax, 'y', ay)), coalesce({ordered}, array()), array(named_struct('x', bx, 'y', by))) AS way",
        )
        .selectExpr(*key, f"inline({g.ring_edges_sql('way')})")
        .where("ax <> bx OR ay <> by")
    )


def even_odd_rings(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed rings around the inside of cut edges (rows of ax, ay, bx, by); the inside is on their left.

    No two edges may meet but at their ends.
    """
    points, at = np.unique(edges.reshape(-1, 2), axis=0, return_inverse=True)
    ends = np.sort(at.reshape(-1, 2), axis=1)
    ends, times = np.unique(ends, axis=0, return_counts=True)
    ends = ends[(times % 2 == 1) & (ends[:, 0] != ends[:, 1])]
    if not len(ends):
        return []
    n = len(ends)
    tail, head = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    twin = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    way = points[head] - points[tail]
    order = np.lexsort([np.arctan2(way[:, 1], way[:, 0]), tail])
    place = np.empty(2 * n, np.int64)
    place[order] = np.arange(2 * n)
    first = np.searchsorted(tail[order], np.arange(len(points)))
    degree = np.bincount(tail, minlength=len(points))
    # at the head, the next edge of the face on the left is the one just clockwise of the way back
    back = place[twin]
    following = order[first[head] + (back - first[head] - 1) % degree[head]]
    face = np.full(2 * n, -1)
    faces: list[list[int]] = []
    for start in range(2 * n):
        if face[start] < 0:
            walk, edge = [], start
            while face[edge] < 0:
                face[edge] = len(faces)
                walk.append(edge)
                edge = int(following[edge])
            faces.append(walk)
    inside = np.full(len(faces), -1)
    a, b = points[tail[:n]], points[head[:n]]
    component = _components(ends, len(points))
    for c in np.unique(component[tail]):
        own = np.flatnonzero(component[tail] == c)
        # the leftmost point lies on the outer side; other components to its right tell whether that is inside
        corner = tail[own[np.lexsort([points[tail[own], 1], points[tail[own], 0]])[0]]]
        x, y = points[corner]
        other = component[ends[:, 0]] != c
        low, high = np.minimum(a[other, 1], b[other, 1]), np.maximum(a[other, 1], b[other, 1])
        spans = (low <= y) & (y < high)
        p, q = a[other][spans], b[other][spans]
        right = p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]) > x
        # of the edges from that point, the one that turns most to the left has the outer side on its left
        out = own[tail[own] == corner]
        outer = face[out[np.argmax(np.arctan2(way[out, 1], way[out, 0]))]]
        inside[outer] = int(right.sum()) % 2
        waiting = [outer]
        while waiting:
            f = waiting.pop()
            for edge in faces[f]:
                g_ = face[twin[edge]]
                if inside[g_] < 0:
                    inside[g_] = 1 - inside[f]
                    waiting.append(g_)
    rings = []
    for f in np.flatnonzero(inside == 1):
        # a walk that comes back to a point is parted there, so that every ring is simple
        path: list[int] = []
        seen: dict[int, int] = {}
        for edge in faces[f]:
            corner = int(tail[edge])
            if corner in seen:
                rings.append(path[seen[corner] :])
                for dropped in path[seen[corner] :]:
                    seen.pop(dropped, None)
                del path[len(seen) :]
            seen[corner] = len(path)
            path.append(corner)
        rings.append(path)
    return [[tuple(points[i].tolist()) for i in (*ring, ring[0])] for ring in rings if len(ring) > 2]


def _components(ends: np.ndarray, n: int) -> np.ndarray:
    """Least point that each point is joined to by edges."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, ends[:, 0], least[ends[:, 1]])
        np.minimum.at(new, ends[:, 1], least[ends[:, 0]])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _traced(noded: DataFrame, key: list[str]) -> DataFrame:
    """The key and __rings of every outline; a task holds the edges of one outline at a time."""

    def trace(table: pa.Table) -> pa.Table:
        edges = np.stack([table[c].to_numpy() for c in ("ax", "ay", "bx", "by")], axis=1)
        rings = [[{"x": x, "y": y} for x, y in ring] for ring in even_odd_rings(edges)]
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        return pa.Table.from_arrays(
            [*(table[k].slice(0, 1) for k in key), pa.array([rings], pa.list_(pa.list_(point)))], names=[*key, "__rings"]
        )

    ring = "array<array<struct<x: double, y: double>>>"
    return noded.groupBy(*key).applyInArrow(trace, ", ".join([*(f"{k} long" for k in key), f"__rings {ring}"]))


def make_valid(df: DataFrame, key: Sequence[str] | str, geom: str = "geometry") -> DataFrame:
    """Every polygon made valid; valid ones keep their rings.

    Repeated points go, open rings are closed, rings without area are dropped and
    the others oriented (see ``repaired_rings_sql``); what is invalid after that
    is cut and traced by the even-odd rule.  Equal outlines are traced once.  An
    outline that encloses nothing becomes a geometry without rings, which is not
    valid; a null geometry stays null.
    """
    tidy = df.withColumn("__rings", F.expr(repaired_rings_sql(f"{geom}.rings"))).drop(geom)
    first = written(with_geometry(tidy, key, "__rings", geom), "tidied")
    bad = first.where(f"NOT {geom}.valid").withColumn("__es", F.expr(g.numbered_edges_sql(f"{geom}.rings")))
    bad = bad.selectExpr("*", "xxhash64(__es) AS __outline_a", "xxhash64(17, __es) AS __outline_b")
    outlines = bad.select(*_OUTLINE, "__es").dropDuplicates(_OUTLINE)
    traced = _traced(noded_edges(outlines, _OUTLINE), _OUTLINE)
    mended = bad.drop(geom, "__es").join(traced, _OUTLINE, "left").drop(*_OUTLINE)
    mended = mended.withColumn("__rings", F.expr("coalesce(__rings, array())"))
    sound = first.where(f"coalesce({geom}.valid, true)")
    return sound.unionByName(with_geometry(mended, key, "__rings", geom).select(*sound.columns)).select(*df.columns)
