"""Plain-SQL side of the correctness check.

Layer definitions and spatial predicates as SQL text over unnested edge lists.
The formulas are deliberately other ones than in ``functions.geometry``:
even-odd crossing instead of winding, shoelace instead of trapezoids.
"""

from __future__ import annotations

import re

from .layers import RATINGS, SHAPES, STATE_CODES, ZONES


def _state(column: str) -> str:
    codes = ", ".join(f"'{c}'" for c in STATE_CODES)
    return f"([{codes}])[CAST({column} AS INTEGER) + 1]"


def _county(nation: str) -> str:
    return f"{_state(f'({nation}) % 5')} || lpad(CAST({nation} AS VARCHAR), 3, '0')"


def _rings(shape, x0: str, y0: str, unit: str) -> str:
    rings = []
    for ring in shape:
        points = [f"{{'x': {x0} + {unit} * {px}, 'y': {y0} + {unit} * {py}}}" for px, py in ring]
        rings.append("[" + ", ".join(points) + "]")
    return "[" + ", ".join(rings) + "]"


def _square(x0: str, y0: str, side: float) -> str:
    return _rings(SHAPES["square"], x0, y0, f"CAST({side / 4} AS DOUBLE)")


def _shape_case() -> str:
    arms = "\n".join(
        f"        WHEN {condition} THEN {_rings(SHAPES[name], 'x0', 'y0', 'unit')}"
        for condition, name in [
            ("j % 50 = 49", "bowtie"),
            ("j % 5 = 0", "square"),
            ("j % 5 = 1", "triangle"),
            ("j % 5 = 2", "ell"),
            ("j % 5 = 3", "ring"),
            ("j % 5 = 4", "diamond"),
        ]
    )
    return f"CASE\n{arms}\n      END"


def area(e: str) -> str:
    """Shoelace area of an edge list."""
    return f"abs(list_sum(list_transform({e}, lambda p: p.ax * p.by - p.bx * p.ay)) / 2)"


def _on_boundary(e: str, x: str, y: str) -> str:
    return (
        f"len(list_filter({e}, lambda p: (p.bx - p.ax) * ({y} - p.ay) = (p.by - p.ay) * ({x} - p.ax)"
        f" AND {x} BETWEEN least(p.ax, p.bx) AND greatest(p.ax, p.bx)"
        f" AND {y} BETWEEN least(p.ay, p.by) AND greatest(p.ay, p.by))) > 0"
    )


def _odd_crossings(e: str, x: str, y: str) -> str:
    return (
        f"len(list_filter({e}, lambda p: (p.ay > {y}) <> (p.by > {y})"
        f" AND {x} < (p.bx - p.ax) * ({y} - p.ay) / (p.by - p.ay) + p.ax)) % 2 = 1"
    )


def contains(e: str, x: str, y: str) -> str:
    """Point strictly inside."""
    return f"({_odd_crossings(e, x, y)} AND NOT ({_on_boundary(e, x, y)}))"


def covers(e: str, x: str, y: str) -> str:
    return f"({_odd_crossings(e, x, y)} OR {_on_boundary(e, x, y)})"


def boxes(a: str, b: str) -> str:
    return (
        f"({a}.xmin <= {b}.xmax AND {b}.xmin <= {a}.xmax"
        f" AND {a}.ymin <= {b}.ymax AND {b}.ymin <= {a}.ymax)"
    )


def in_box(a: str, x: str, y: str) -> str:
    return f"({x} >= {a}.xmin AND {x} <= {a}.xmax AND {y} >= {a}.ymin AND {y} <= {a}.ymax)"


def _side(o: str, p: str, x: str, y: str) -> str:
    return f"sign(({o}.bx - {o}.ax) * ({p}.{y} - {o}.ay) - ({o}.by - {o}.ay) * ({p}.{x} - {o}.ax))"


def intersects(a: str, b: str) -> str:
    """Polygons (aliases with edges) share a point: edges meet, or one holds a corner of the other."""
    meet = (
        f"{_side('p', 'q', 'ax', 'ay')} * {_side('p', 'q', 'bx', 'by')} <= 0"
        f" AND {_side('q', 'p', 'ax', 'ay')} * {_side('q', 'p', 'bx', 'by')} <= 0"
        " AND least(p.ax, p.bx) <= greatest(q.ax, q.bx) AND least(q.ax, q.bx) <= greatest(p.ax, p.bx)"
        " AND least(p.ay, p.by) <= greatest(q.ay, q.by) AND least(q.ay, q.by) <= greatest(p.ay, p.by)"
    )
    inner_a = covers(f"{a}.edges", "s.ax", "s.ay")
    inner_b = covers(f"{b}.edges", "s.ax", "s.ay")
    return (
        f"(len(list_filter({a}.edges, lambda p: len(list_filter({b}.edges, lambda q: {meet})) > 0)) > 0"
        f" OR len(list_filter({b}.edges, lambda s: {inner_a})) > 0"
        f" OR len(list_filter({a}.edges, lambda s: {inner_b})) > 0)"
    )


def overlap_area(a: str, b: str) -> str:
    """Sum over edge pairs of the signed area under the lower edge."""
    lo = "greatest(least(p.ax, p.bx), least(q.ax, q.bx))"
    hi = "least(greatest(p.ax, p.bx), greatest(q.ax, q.bx))"

    def height(s, x):
        return f"({s}.ay + ({x} - {s}.ax) * ({s}.by - {s}.ay) / ({s}.bx - {s}.ax))"

    p0, p1, q0, q1 = height("p", lo), height("p", hi), height("q", lo), height("q", hi)
    w = f"({hi} - {lo})"
    straight = f"(least({p0}, {q0}) + least({p1}, {q1})) * {w} / 2"
    # where the edges cross, the lower envelope gains a corner; the plain
    # trapezoid misses a triangle below it
    lost = (
        f"CASE WHEN ({p0} - {q0}) * ({p1} - {q1}) < 0 THEN"
        f" abs(({p0} - {q0}) * ({p1} - {q1}) * {w} / (({p0} - {q0}) - ({p1} - {q1})) / 2) ELSE 0 END"
    )
    sign = "CASE WHEN (p.ax > p.bx) = (q.ax > q.bx) THEN 1 ELSE -1 END"
    pair = f"CASE WHEN {lo} < {hi} THEN {sign} * ({straight} + {lost}) ELSE 0 END"
    return (
        f"coalesce(list_sum(list_transform(list_filter({a}.edges, lambda p: p.ax <> p.bx), lambda p:"
        f" coalesce(list_sum(list_transform(list_filter({b}.edges, lambda q: q.ax <> q.bx),"
        f" lambda q: {pair})), 0))), 0)"
    )


_POLYGONS = {
    "county": f"""
      SELECT {_county('n_nationkey')} AS GEOID, {_state('n_nationkey % 5')} AS STATEFP,
        lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS COUNTYFP, n_name AS NAME,
        {_square('(n_nationkey % 5) * CAST(4 AS DOUBLE)', '(n_nationkey // 5) * CAST(4 AS DOUBLE)', 4)} AS rings
      FROM nation""",
    "census_tracts": f"""
      SELECT {_county('s_nationkey')} || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS GEOID,
        {_state('s_nationkey % 5')} AS STATEFP,
        lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS COUNTYFP, s_name AS NAME,
        {_square("(s_nationkey % 5) * CAST(4 AS DOUBLE) + (((s_suppkey * 7) % 32) % 8) * CAST(0.5 AS DOUBLE)",
                 "(s_nationkey // 5) * CAST(4 AS DOUBLE) + (((s_suppkey * 7) % 32) // 8) * CAST(0.5 AS DOUBLE)", 0.5)} AS rings
      FROM supplier""",
    "zcta": f"""
      SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS GEOID, {_state('n_nationkey % 5')} AS STATEFP,
        {_square('(n_nationkey % 5) * CAST(4 AS DOUBLE) - CAST(1.25 AS DOUBLE)',
                 '(n_nationkey // 5) * CAST(4 AS DOUBLE) - CAST(1.25 AS DOUBLE)', 4)} AS rings
      FROM nation""",
    "floodplain": f"""
      SELECT CAST(j AS VARCHAR) AS GFID, zone AS FLD_ZONE, {_state('floor(x0 / 4)')} AS STATEFP,
        {_shape_case()} AS rings
      FROM (SELECT o_orderkey AS j,
          CAST((37 * o_orderkey) % 1280 AS DOUBLE) / 64 AS x0,
          CAST((91 * o_orderkey + 17 * (o_orderkey // 1280)) % 1280 AS DOUBLE) / 64 AS y0,
          CASE WHEN o_orderkey % 16 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.0625 AS DOUBLE) END AS unit,
          CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ZONES.items())} END AS zone
        FROM orders)""",
}


def _with_shape(body: str) -> str:
    """Bounds, edges and validity on top of a rings column."""
    points = "flatten(list_transform(rings, lambda r: list_transform(r, lambda v: v.{c})))"
    edge_list = (
        "flatten(list_transform(rings, lambda r: list_transform(range(1, len(r)), lambda i:"
        " {'ax': r[i].x, 'ay': r[i].y, 'bx': r[i + 1].x, 'by': r[i + 1].y})))"
    )
    cross = (
        f"{_side('p', 'q', 'ax', 'ay')} * {_side('p', 'q', 'bx', 'by')} < 0"
        f" AND {_side('q', 'p', 'ax', 'ay')} * {_side('q', 'p', 'bx', 'by')} < 0"
    )
    return f"""
    SELECT *, len(list_filter(edges, lambda p: len(list_filter(edges, lambda q: {cross})) > 0)) = 0 AS valid
    FROM (SELECT *, {edge_list} AS edges,
        list_min({points.format(c='x')}) AS xmin, list_max({points.format(c='x')}) AS xmax,
        list_min({points.format(c='y')}) AS ymin, list_max({points.format(c='y')}) AS ymax
      FROM ({body}))"""


_TRACT = f"{_county('s_nationkey')} || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')"


def _point_select(table: str, key: str, fx: int, fy: int, columns: str) -> str:
    shift = f"CASE WHEN {key} % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) / 128 END"
    return f"""
      SELECT {columns}, {_state('nation_no % 5')} AS STATEFP, LON, LAT
      FROM (SELECT *, CAST(coalesce(floor(LON / 4) + 5 * floor(LAT / 4), {key} % 25) AS INTEGER) AS nation_no
        FROM (SELECT *,
            CASE WHEN {key} % 41 <> 0 THEN CAST(({fx} * {key}) % 1280 AS DOUBLE) / 64 + {shift} END AS LON,
            CASE WHEN {key} % 41 <> 0 THEN CAST(({fy} * {key}) % 1280 AS DOUBLE) / 64 + {shift} END AS LAT
          FROM {table}))"""


def _quarter(factor: int, modulus: int, part: int) -> str:
    return f"CAST((s_suppkey * {factor}) % {modulus} AS DOUBLE) / {part}"


def _or_sentinel(expr: str) -> str:
    return f"CASE WHEN s_suppkey % 17 = 0 THEN CAST(-999 AS DOUBLE) ELSE {expr} END"


_TABLES = {
    "claims": f"""
      SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
        {_TRACT} AS GEOID, {_state('s_nationkey % 5')} AS STATEFP,
        CASE WHEN l_orderkey % 101 <> 0 THEN CAST(l_shipdate AS DATE) END AS dateOfLoss,
        CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS amountPaidOnBuildingClaim,
        CAST(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS DECIMAL(12,2)) AS amountPaidOnContentsClaim,
        CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity * 10 ELSE 0 END AS DECIMAL(12,2))
          AS amountPaidOnIncreasedCostOfComplianceClaim
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "nri": f"""
      SELECT {_TRACT} AS GEOID,
        CASE WHEN s_suppkey % 11 <> 0 THEN {_quarter(29, 101, 1)} END AS CFLD_RISKS,
        {_quarter(41, 997, 1)} AS CFLD_EALP, {_quarter(31, 101, 1)} AS RFLD_RISKS,
        CASE WHEN s_suppkey % 7 <> 0 THEN {_quarter(43, 1009, 4)} END AS RFLD_RISKV,
        ([{', '.join(f"'{r}'" for r in RATINGS)}])[CAST(s_suppkey % 5 AS INTEGER) + 1] AS RFLD_RISKR,
        {_quarter(13, 64, 1)} AS RFLD_EVNTS, {_quarter(17, 64, 16)} AS RFLD_AFREQ,
        {_quarter(19, 8192, 1)} AS RFLD_EXP_AREA, {_quarter(7919, 65536, 1)} AS RFLD_EALB,
        CASE WHEN s_suppkey % 19 <> 0 THEN {_quarter(6151, 32768, 8)} END AS RFLD_EALT
      FROM supplier""",
    "svi": f"""
      SELECT {_TRACT} AS GEOID, CAST({_TRACT} AS BIGINT) AS FIPS,
        CAST((s_suppkey * 37) % 9001 AS BIGINT) AS E_TOTPOP,
        CASE WHEN s_suppkey % 23 <> 0 THEN CAST((s_suppkey * 11) % 4001 AS BIGINT) END AS E_HH,
        {_or_sentinel(_quarter(13, 401, 4))} AS EP_NOINT, {_or_sentinel(_quarter(17, 401, 4))} AS EP_POV150,
        {_or_sentinel(_quarter(19, 401, 4))} AS EP_LIMENG, {_or_sentinel(_quarter(23, 401, 4))} AS EP_MINRTY,
        {_or_sentinel(_quarter(29, 401, 4))} AS EP_UNEMP,
        {_or_sentinel(_quarter(31, 129, 128))} AS RPL_THEME1, {_or_sentinel(_quarter(37, 129, 128))} AS RPL_THEME4,
        {_or_sentinel(_quarter(41, 129, 128))} AS RPL_THEMES, {_or_sentinel(_quarter(43, 129, 128))} AS SPL_THEME1,
        {_or_sentinel(_quarter(47, 129, 128))} AS SPL_THEMES
      FROM supplier""",
    "cre": f"""
      SELECT {_TRACT} AS GEOID, CAST((s_suppkey * 53) % 16384 AS BIGINT) AS POPUNI,
        CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS WATER_TRACT,
        CAST((s_suppkey * 59) % 4097 AS BIGINT) AS PRED12_E,
        CASE WHEN s_suppkey % 29 <> 0 THEN {_quarter(61, 401, 4)} END AS PRED0_PE,
        {_quarter(67, 401, 4)} AS PRED12_PE,
        CASE WHEN s_suppkey % 31 <> 0 THEN {_quarter(71, 441, 4)} END AS PRED3_PE
      FROM supplier""",
    "hospitals": _point_select(
        "customer", "c_custkey", 53, 71,
        "CAST(c_custkey AS VARCHAR) AS HOSPITAL_ID, c_name AS NAME,"
        " upper(c_mktsegment) || ' ' || CAST(c_custkey % 30 AS VARCHAR) AS CITY,"
        " lpad(CAST(c_custkey % 500 AS VARCHAR), 5, '0') AS ZIP,"
        f" {_county('nation_no')} AS COUNTYFIPS, upper(c_mktsegment) AS TYPE,"
        " 'H' || CAST(c_custkey AS VARCHAR) AS UNIQUE_ID",
    ),
    "schools": _point_select(
        "part", "p_partkey", 59, 83,
        "CAST(p_partkey AS VARCHAR) AS SCHOOL_ID, p_name AS NAME, upper(p_brand) AS CITY,"
        " lpad(CAST(p_partkey % 500 AS VARCHAR), 5, '0') AS ZIP, upper(p_type) AS TYPE,"
        " 'S' || CAST(p_partkey AS VARCHAR) AS UNIQUE_ID",
    ),
}


def with_layers(sql: str) -> str:
    """Put the definitions of the layers a query names in front of it."""
    parts = [
        f"{name} AS MATERIALIZED ({_with_shape(body)})"
        for name, body in _POLYGONS.items()
        if re.search(rf"\b{name}\b", sql)
    ]
    parts += [
        f"{name} AS ({body})" for name, body in _TABLES.items() if re.search(rf"\b{name}\b", sql)
    ]
    sql = sql.strip()
    if not parts:
        return sql
    if sql[:5].upper() == "WITH ":
        parts.append(sql[5:])
        return "WITH " + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + sql
