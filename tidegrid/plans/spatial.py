"""Questions over spatially joined layers.

A gold question often averages over joined pairs, so a tract counts once per
floodplain it meets.  The partners of a row are counted by ``partner_counts``,
which sees every different geometry once, and carried on as a weight: same
result, no fan-out in the later joins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import county_key, has_prefix, tract_text
from ..operators.aggregates import coverage_share, top_n, weighted_avg
from ..operators.key_join import JOIN_RULES, _layer_of, join_layers
from ..operators.copies import code, once
from ..operators.spatial_join import distance_join, near_counts, partner_counts, spatial_join
from . import sql as s
from .registry import query

XY = ("LON", "LAT")


def row_count():
    return F.count(F.lit(1))


def _polygons(layers, name, *columns, valid=True, where=None, geom="geometry"):
    """Columns and geometry (renamed to ``geom``) of a polygon layer."""
    rows = layers[name]
    if where is not None:
        rows = rows.where(where)
    if valid:
        rows = rows.where("geometry.valid")
    return rows.select(*columns, F.col("geometry").alias(geom))


def _floods(layers, valid=True):
    return _polygons(layers, "floodplain", "GFID", valid=valid, geom="flood_geom")


def flood_counts(layers, tracts_where, valid_tract=True, valid_flood=True):
    """Number of floodplains each tract meets: GEOID, n_floods."""
    tracts = _polygons(
        layers, "census_tracts", "GEOID", valid=valid_tract, where=tracts_where, geom="tract_geom"
    )
    counted = partner_counts(
        tracts, _floods(layers, valid_flood), "intersects", a_geom="tract_geom", b_geom="flood_geom"
    )
    return counted.groupBy("GEOID").agg(F.sum("n_partners").alias("n_floods"))


def flooded_tracts(layers, tracts_where, valid_tract=True):
    """Keys of tracts that meet any valid floodplain."""
    tracts = _polygons(
        layers, "census_tracts", "GEOID", valid=valid_tract, where=tracts_where, geom="tract_geom"
    )
    return spatial_join(
        tracts, _floods(layers), "intersects", "left_semi",
        a_geom="tract_geom", b_geom="flood_geom", left_key="GEOID",
    ).select("GEOID")


def _sql_pairs(where, valid="t.valid AND f.valid"):
    return (
        "WITH pairs AS (SELECT t.GEOID, t.STATEFP, f.GFID FROM census_tracts t JOIN floodplain f"
        f" ON {s.boxes('t', 'f')} WHERE {where} AND {valid} AND {s.intersects('t', 'f')}) "
    )


def _sql_points(layer, polygons, alias, columns, where="TRUE"):
    """CTE of points strictly inside polygons."""
    return (
        f"{alias} AS (SELECT {columns} FROM {layer} p JOIN {polygons} g ON {s.in_box('g', 'p.LON', 'p.LAT')}"
        f" WHERE {where} AND {s.contains('g.edges', 'p.LON', 'p.LAT')})"
    )


# -- an indicator over tracts that meet floodplains ------------------------------

def _indicator(name, layer, tracts_where, value_where, mode, column, alias, *,
               per_pair, fips=False, valid_tract=True, valid_flood=True):
    """mode: avg, sum or count of an indicator column; per_pair keeps the
    multiplicity of the spatial join, otherwise each tract counts once."""
    key = "v.FIPS = CAST(p.GEOID AS BIGINT)" if fips else "v.GEOID = p.GEOID"
    source = "pairs" if per_pair else "(SELECT DISTINCT GEOID FROM pairs)"
    measure = {
        "avg": f"ROUND(AVG(v.{column}), 6)",
        "sum": f"ROUND(CAST(SUM(v.{column}) AS DOUBLE), 6)",
        "count": "COUNT(*)",
    }[mode]
    checks = [c for c, on in (("t.valid", valid_tract), ("f.valid", valid_flood)) if on]

    @query(
        name,
        _sql_pairs(tracts_where.replace("GEOID", "t.GEOID").replace("STATEFP", "t.STATEFP"),
                   " AND ".join(checks) or "TRUE")
        + f"SELECT {measure} AS {alias} FROM {layer} v JOIN {source} p ON {key} WHERE {value_where}",
    )
    def run(layers):
        values = layers[layer].where(value_where)
        if fips:
            values = values.withColumn("GEOID", tract_text("FIPS"))
        if per_pair:
            keys = flood_counts(layers, tracts_where, valid_tract, valid_flood)
        else:
            keys = flooded_tracts(layers, tracts_where, valid_tract).withColumn("n_floods", F.lit(1))
        joined = values.join(keys, "GEOID")
        weight = F.col("n_floods")
        out = {
            "avg": lambda: F.round(weighted_avg(F.col(column), weight), 6),
            "sum": lambda: F.round(F.sum(F.col(column) * weight).cast("double"), 6),
            "count": lambda: F.coalesce(F.sum(weight), F.lit(0)),
        }[mode]()
        return joined.agg(out.cast("bigint" if mode == "count" else "double").alias(alias))


_indicator("tract_flood_intersects_avg", "svi", "STATEFP = '48'",
           "RPL_THEME1 IS NOT NULL AND RPL_THEME1 BETWEEN 0 AND 100",
           "avg", "RPL_THEME1", "avg_theme1_rank", per_pair=True)
_indicator("vulnerable_tract_flood_pairs", "cre", "GEOID LIKE '48%'",
           "PRED3_PE > 40 AND PRED3_PE BETWEEN 0 AND 100",
           "count", "*", "num_high_vuln_tracts", per_pair=True)
_indicator("risky_tract_flood_pairs", "nri", "GEOID LIKE '12%'", "RFLD_RISKS > 70",
           "count", "*", "num_high_risk_tracts", per_pair=True)
_indicator("county_riverine_risk_avg", "nri", "LEFT(GEOID, 5) = '22007'", "RFLD_RISKV IS NOT NULL",
           "avg", "RFLD_RISKV", "avg_riverine_risk", per_pair=True)
_indicator("state_vulnerability_avg", "cre", "STATEFP = '48'", "PRED3_PE BETWEEN 0 AND 100",
           "avg", "PRED3_PE", "avg_high_vulnerability", per_pair=True)
_indicator("vulnerability_avg_unchecked", "cre", "GEOID LIKE '22%'", "PRED3_PE BETWEEN 0 AND 100",
           "avg", "PRED3_PE", "avg_high_vulnerability_pct", per_pair=True,
           valid_tract=False, valid_flood=False)
_indicator("exists_spatial_semi", "nri", "GEOID LIKE '22%'", "RFLD_EXP_AREA BETWEEN 0 AND 1e9",
           "avg", "RFLD_EXP_AREA", "avg_exposed_area", per_pair=False)
_indicator("exists_flood_events_avg", "nri", "GEOID LIKE '12%'", "RFLD_EVNTS BETWEEN 0 AND 1000",
           "avg", "RFLD_EVNTS", "avg_flood_events", per_pair=False)
_indicator("distinct_then_avg", "cre", "GEOID LIKE '12%'", "TRUE",
           "avg", "POPUNI", "avg_population_universe", per_pair=False)
_indicator("distinct_then_avg_48", "cre", "GEOID LIKE '48%'", "TRUE",
           "avg", "POPUNI", "avg_population_universe", per_pair=False)
_indicator("exists_county_rank_avg", "svi", "LEFT(GEOID, 5) = '12011'",
           "RPL_THEMES IS NOT NULL AND RPL_THEMES BETWEEN 0 AND 100",
           "avg", "RPL_THEMES", "avg_svi_for_flooded_tracts", per_pair=False, valid_tract=False)
_indicator("poor_flooded_tracts", "svi", "LEFT(GEOID, 5) = '12011'",
           "EP_POV150 BETWEEN 0 AND 100 AND EP_POV150 > 25",
           "count", "*", "num_high_poverty_tracts", per_pair=False, fips=True)
_indicator("cte_affected_population", "svi", "GEOID LIKE '12%'", "E_TOTPOP IS NOT NULL",
           "sum", "E_TOTPOP", "total_population", per_pair=False, fips=True)
_indicator("exists_population_sum", "cre", "LEFT(GEOID, 5) = '12016'", "POPUNI IS NOT NULL",
           "sum", "POPUNI", "total_population_universe", per_pair=False)
_indicator("limited_english_flooded_tracts", "svi", "LEFT(GEOID, 5) = '48010'",
           "EP_LIMENG BETWEEN 0 AND 100 AND EP_LIMENG > 10",
           "count", "*", "num_limited_english_tracts", per_pair=False, fips=True)
_indicator("distinct_loss_avg", "nri", "GEOID LIKE '48%'", "RFLD_EALB BETWEEN 0 AND 1e9",
           "avg", "RFLD_EALB", "avg_building_loss", per_pair=False)
_indicator("minority_flooded_tracts", "svi", "LEFT(GEOID, 5) = '48010'",
           "EP_MINRTY BETWEEN 0 AND 100 AND EP_MINRTY > 60",
           "count", "*", "num_minority_tracts", per_pair=False, fips=True)
_indicator("distinct_unemployment_avg", "svi", "GEOID LIKE '12%'", "EP_UNEMP BETWEEN 0 AND 100",
           "avg", "EP_UNEMP", "avg_unemployment", per_pair=False, fips=True)


@query(
    "pairs_vs_distinct_count",
    _sql_pairs("t.GEOID LIKE '12%'")
    + "SELECT COUNT(*) AS num_pairs, COUNT(DISTINCT GEOID) AS num_tracts, COUNT(DISTINCT GFID) AS num_floods FROM pairs",
)
def pairs_vs_distinct_count(layers):
    """Multiplicity of a spatial join beside the distinct counts."""
    tracts = _polygons(layers, "census_tracts", "GEOID", where="GEOID LIKE '12%'", geom="tract_geom")
    geoms = {"a_geom": "tract_geom", "b_geom": "flood_geom"}
    counted = partner_counts(tracts, _floods(layers), "intersects", **geoms)
    met = partner_counts(_floods(layers), tracts, "intersects", a_geom="flood_geom", b_geom="tract_geom")
    pairs = counted.agg(
        F.coalesce(F.sum("n_partners"), F.lit(0)).alias("num_pairs"), F.count_distinct("GEOID").alias("num_tracts")
    )
    return pairs.crossJoin(met.agg(F.count_distinct("GFID").alias("num_floods")))


@query(
    "tracts_meeting_floods",
    _sql_pairs("t.GEOID LIKE '12006%'") + "SELECT COUNT(DISTINCT GEOID) AS num_census_tracts FROM pairs",
)
def tracts_meeting_floods(layers):
    return flooded_tracts(layers, "GEOID LIKE '12006%'").agg(row_count().alias("num_census_tracts"))


# -- the same, ranked by county --------------------------------------------------

def _county_names(layers, state):
    return layers["county"].where(F.col("STATEFP") == state).select(
        F.col("GEOID").alias("county_geoid"), F.col("NAME").alias("county_name")
    )


def _county_ranking(name, layer, state, value_where, measure_sql, measure, n, fips=False):
    key = "v.FIPS = CAST(p.GEOID AS BIGINT)" if fips else "v.GEOID = p.GEOID"

    @query(
        name,
        _sql_pairs(f"LEFT(t.GEOID, 2) = '{state}'")
        + f"SELECT c.NAME AS county_name FROM {layer} v JOIN pairs p ON {key}"
        f" JOIN county c ON LEFT(p.GEOID, 5) = c.GEOID WHERE c.STATEFP = '{state}' AND {value_where}"
        f" GROUP BY c.NAME ORDER BY {measure_sql} DESC, c.NAME LIMIT {n}",
    )
    def run(layers):
        values = layers[layer].where(value_where)
        if fips:
            values = values.withColumn("GEOID", tract_text("FIPS"))
        joined = (
            values.join(flood_counts(layers, has_prefix("GEOID", state)), "GEOID")
            .withColumn("county_geoid", county_key())
            .join(_county_names(layers, state), "county_geoid")
        )
        return top_n(joined, ["county_name"], measure(F.col("n_floods")), n)


_county_ranking("county_rank_by_avg", "svi", "48", "SPL_THEMES IS NOT NULL AND SPL_THEMES BETWEEN 0 AND 100",
                "AVG(v.SPL_THEMES)", lambda w: weighted_avg(F.col("SPL_THEMES"), w), 5, fips=True)
_county_ranking("county_rank_by_pairs", "cre", "12", "PRED0_PE < 10 AND PRED0_PE BETWEEN 0 AND 100",
                "COUNT(*)", lambda w: F.sum(w), 1)
_county_ranking("county_rank_by_loss", "nri", "48", "TRUE",
                "SUM(v.RFLD_EALB)", lambda w: F.sum(F.col("RFLD_EALB") * w), 1)


# -- facilities in floodplains, tracts and counties --------------------------------

def _hospitals(layers, *columns, where=None):
    rows = layers["hospitals"]
    if where is not None:
        rows = rows.where(where)
    return rows.select("HOSPITAL_ID", *columns, *XY)


def _schools(layers, *columns, where=None):
    rows = layers["schools"]
    if where is not None:
        rows = rows.where(where)
    return rows.select("SCHOOL_ID", *columns, *XY)


def hospitals_by_county(layers, state, n):
    """Counties with the most hospital-floodplain pairs."""
    counties = _county_names(layers, state).withColumnRenamed("county_geoid", "COUNTYFIPS")
    valid = layers["county"].where("geometry.valid").select(F.col("GEOID").alias("COUNTYFIPS"))
    inside = partner_counts(
        _hospitals(layers, "COUNTYFIPS", where=has_prefix("COUNTYFIPS", state)), _floods(layers),
        "within", a_geom=XY, b_geom="flood_geom",
    )
    counts = inside.groupBy("COUNTYFIPS").agg(F.sum("n_partners").alias("n"))
    joined = counts.join(counties, "COUNTYFIPS").join(valid, "COUNTYFIPS", "left_semi")
    return top_n(joined, ["county_name"], F.sum("n"), n)


def _hospitals_by_county_sql(state, n):
    return (
        "WITH " + _sql_points("hospitals", "floodplain", "inside", "p.HOSPITAL_ID, p.COUNTYFIPS", "g.valid")
        + " SELECT c.NAME AS county_name FROM inside h JOIN county c ON LEFT(h.COUNTYFIPS, 5) = c.GEOID"
        f" WHERE c.STATEFP = '{state}' AND c.valid GROUP BY c.NAME ORDER BY COUNT(*) DESC, c.NAME LIMIT {n}"
    )


@query("hospitals_in_flood_topn", _hospitals_by_county_sql("12", 5))
def hospitals_in_flood_topn(layers):
    return hospitals_by_county(layers, "12", 5)


@query(
    "hospitals_in_flood_exists",
    "WITH " + _sql_points("hospitals", "floodplain", "inside", "DISTINCT p.HOSPITAL_ID, p.COUNTYFIPS", "g.valid")
    + " SELECT c.NAME AS county_name FROM inside h JOIN county c ON LEFT(h.COUNTYFIPS, 5) = c.GEOID"
    " WHERE c.STATEFP = '22' GROUP BY c.NAME ORDER BY COUNT(*) DESC, c.NAME LIMIT 3",
)
def hospitals_in_flood_exists(layers):
    rows = _hospitals(layers, F.left("COUNTYFIPS", F.lit(5)).alias("county_geoid"))
    inside = spatial_join(rows, _floods(layers), "within", "left_semi", a_geom=XY, b_geom="flood_geom")
    return top_n(inside.join(_county_names(layers, "22"), "county_geoid"), ["county_name"], row_count(), 3)


@query(
    "hospital_county_risk_avg",
    "WITH " + _sql_points("hospitals", "county", "inside", "g.GEOID", "g.NAME = 'NATION_7' AND g.STATEFP = '22' AND g.valid")
    + " SELECT ROUND(AVG(n.CFLD_RISKS), 6) AS avg_coastal_risk_score FROM inside h"
    " JOIN nri n ON LEFT(n.GEOID, 5) = h.GEOID WHERE n.CFLD_RISKS IS NOT NULL",
)
def hospital_county_risk_avg(layers):
    county = _polygons(layers, "county", "GEOID", where="NAME = 'NATION_7' AND STATEFP = '22'")
    counts = _hospital_counts(layers, county)
    known = F.col("CFLD_RISKS").isNotNull() & has_prefix("GEOID", "22")
    rows = layers["nri"].where(known).withColumn("county_geoid", county_key())
    joined = rows.join(counts, "county_geoid")
    return joined.agg(
        F.round(weighted_avg(F.col("CFLD_RISKS"), F.col("n")), 6).alias("avg_coastal_risk_score")
    )


def _hospital_counts(layers, county):
    """Hospitals inside each of some county polygons: county_geoid, n."""
    hosting = partner_counts(county, _hospitals(layers), "contains", b_geom=XY)
    return hosting.groupBy(F.col("GEOID").alias("county_geoid")).agg(F.sum("n_partners").alias("n"))


@query(
    "unknown_county_is_null",
    "WITH " + _sql_points("hospitals", "county", "inside", "g.GEOID", "g.NAME = 'nation_7' AND g.valid")
    + " SELECT ROUND(AVG(n.CFLD_RISKS), 6) AS avg_coastal_risk_score FROM inside h"
    " JOIN nri n ON LEFT(n.GEOID, 5) = h.GEOID",
)
def unknown_county_is_null(layers):
    """No row matches (names are case-sensitive), so the mean is NULL."""
    counts = _hospital_counts(layers, _polygons(layers, "county", "GEOID", where="NAME = 'nation_7'"))
    joined = layers["nri"].withColumn("county_geoid", county_key()).join(counts, "county_geoid")
    return joined.agg(
        F.round(weighted_avg(F.col("CFLD_RISKS"), F.col("n")), 6).alias("avg_coastal_risk_score")
    )


@query(
    "schools_in_flood_state_counties",
    "WITH " + _sql_points("schools", "floodplain", "inside", "DISTINCT p.SCHOOL_ID, p.STATEFP", "g.valid")
    + " SELECT c.NAME AS county_name FROM inside s JOIN county c ON s.STATEFP = c.STATEFP"
    " WHERE c.STATEFP = '22' GROUP BY c.NAME ORDER BY COUNT(DISTINCT s.SCHOOL_ID) DESC, c.NAME LIMIT 5",
)
def schools_in_flood_state_counties(layers):
    """State-level join after a spatial EXISTS; schools are counted per state first."""
    rows = _schools(layers, "STATEFP", where=F.col("STATEFP") == "22")
    inside = spatial_join(rows, _floods(layers), "within", "left_semi", a_geom=XY, b_geom="flood_geom")
    counts = inside.groupBy("STATEFP").agg(F.count_distinct("SCHOOL_ID").alias("n"))
    counties = layers["county"].select("STATEFP", F.col("NAME").alias("county_name"))
    return top_n(counties.join(counts, "STATEFP"), ["county_name"], F.max("n"), 5)


@query(
    "claimed_tract_floods",
    _sql_pairs("LEFT(t.GEOID, 5) = '22007'")
    + "SELECT COUNT(DISTINCT p.GFID) AS num_intersecting_floodplains FROM pairs p"
    " WHERE EXISTS (SELECT 1 FROM claims cl WHERE cl.GEOID = p.GEOID)",
)
def claimed_tract_floods(layers):
    """Floodplains that meet a tract with claims: the floodplain side is kept."""
    tracts = _polygons(
        layers, "census_tracts", "GEOID", where=has_prefix("GEOID", "22007"), geom="tract_geom"
    ).join(layers["claims"].select("GEOID"), "GEOID", "left_semi")
    met = spatial_join(
        _floods(layers), tracts, "intersects", "left_semi",
        a_geom="flood_geom", b_geom="tract_geom", left_key="GFID",
        b_layer=_tracts(layers, where=has_prefix("GEOID", "22007")),
    )
    return met.agg(F.count_distinct("GFID").alias("num_intersecting_floodplains"))


@query(
    "claimed_and_flooded_tracts",
    _sql_pairs("LEFT(t.GEOID, 5) = '22007'")
    + "SELECT COUNT(DISTINCT p.GEOID) AS num_claim_tracts FROM pairs p"
    " WHERE EXISTS (SELECT 1 FROM claims cl WHERE cl.GEOID = p.GEOID)",
)
def claimed_and_flooded_tracts(layers):
    flooded = flooded_tracts(layers, has_prefix("GEOID", "22007"))
    kept = flooded.join(layers["claims"].select("GEOID"), "GEOID", "left_semi")
    return kept.agg(F.count_distinct("GEOID").alias("num_claim_tracts"))


@query(
    "city_with_schools_at_risk",
    "WITH " + _sql_points("schools", "county", "inside", "p.SCHOOL_ID, p.CITY, g.GEOID", "p.STATEFP = '48' AND g.valid")
    + " SELECT s.CITY AS city_name FROM inside s JOIN nri n ON LEFT(n.GEOID, 5) = s.GEOID"
    " WHERE n.RFLD_RISKS > 50 GROUP BY s.CITY ORDER BY COUNT(DISTINCT s.SCHOOL_ID) DESC, s.CITY LIMIT 1",
)
def city_with_schools_at_risk(layers):
    risky = layers["nri"].where(F.col("RFLD_RISKS") > 50).select(county_key().alias("GEOID"))
    county = _polygons(layers, "county", "GEOID").join(risky, "GEOID", "left_semi")
    rows = _schools(layers, "CITY", where=F.col("STATEFP") == "48")
    inside = spatial_join(
        rows, county, "within", "left_semi", a_geom=XY, b_layer=_polygons(layers, "county")
    )
    return top_n(
        inside.withColumnRenamed("CITY", "city_name"), ["city_name"], F.count_distinct("SCHOOL_ID"), 1
    )


@query(
    "flooded_hospital_county_claims",
    "WITH " + _sql_points("hospitals", "floodplain", "inside", "p.COUNTYFIPS", "p.STATEFP = '12' AND g.valid")
    + ", h AS (SELECT COUNTYFIPS, COUNT(*) AS n FROM inside GROUP BY COUNTYFIPS)"
    " SELECT ROUND(SUM(CAST(cl.amountPaidOnBuildingClaim AS DOUBLE) * h.n) / SUM(h.n), 4)"
    " AS avg_county_building_claim FROM h JOIN claims cl ON LEFT(cl.GEOID, 5) = h.COUNTYFIPS"
    " WHERE cl.amountPaidOnBuildingClaim IS NOT NULL",
)
def flooded_hospital_county_claims(layers):
    """Mean over hospital-claim pairs of a county, from per-county sums."""
    rows = _hospitals(layers, "COUNTYFIPS", where=F.col("STATEFP") == "12")
    inside = partner_counts(rows, _floods(layers), "within", a_geom=XY, b_geom="flood_geom")
    hospitals = inside.groupBy(F.col("COUNTYFIPS").alias("county_geoid")).agg(F.sum("n_partners").alias("n"))
    # a county key begins with its state's, so the state filter holds for the claims too
    joined = _claim_sums(layers, "12").join(hospitals, "county_geoid")
    mean = F.try_divide(F.sum(F.col("paid") * F.col("n")), F.sum(F.col("claims") * F.col("n")).cast("double"))
    return joined.agg(F.round(mean, 4).alias("avg_county_building_claim"))


def _claim_sums(layers, prefix):
    """Building payout and number of claims per county whose key starts with a known prefix."""
    paid = F.col("amountPaidOnBuildingClaim")
    return (
        layers["claims"].where(paid.isNotNull() & has_prefix("GEOID", prefix))
        .groupBy(county_key().alias("county_geoid"))
        .agg(F.sum(paid.cast("double")).alias("paid"), row_count().alias("claims"))
    )


def _county_claims(name, geoid):
    @query(
        name,
        "WITH " + _sql_points("hospitals", "county", "inside", "g.GEOID", f"g.GEOID = '{geoid}' AND g.valid")
        + ", h AS (SELECT GEOID, COUNT(*) AS n FROM inside GROUP BY GEOID)"
        " SELECT ROUND(SUM(CAST(l.amountPaidOnBuildingClaim AS DOUBLE) * h.n), 2) AS total_claims_paid"
        " FROM h JOIN claims l ON LEFT(l.GEOID, 5) = h.GEOID WHERE l.amountPaidOnBuildingClaim IS NOT NULL",
    )
    def run(layers):
        hospitals = _hospital_counts(
            layers, _polygons(layers, "county", "GEOID", where=F.col("GEOID") == geoid)
        )
        joined = _claim_sums(layers, geoid).join(hospitals, "county_geoid")
        return joined.agg(F.round(F.sum(F.col("paid") * F.col("n")), 2).alias("total_claims_paid"))


_county_claims("hospital_county_claims_sum", "48010")
_county_claims("hospital_county_claims_sum_22", "22012")


@query(
    "schools_in_flooded_tracts",
    _sql_pairs("TRUE")
    + ", " + _sql_points("schools", "census_tracts", "inside", "p.SCHOOL_ID, g.GEOID", "g.valid")
    + " SELECT c.NAME AS county_name FROM inside s JOIN county c ON LEFT(s.GEOID, 5) = c.GEOID"
    " WHERE c.STATEFP = '22' AND s.GEOID IN (SELECT GEOID FROM pairs)"
    " GROUP BY c.NAME ORDER BY COUNT(DISTINCT s.SCHOOL_ID) DESC, c.NAME LIMIT 5",
)
def schools_in_flooded_tracts(layers):
    flooded = flooded_tracts(layers, has_prefix("GEOID", "22"))
    tracts = _polygons(layers, "census_tracts", "GEOID", where=has_prefix("GEOID", "22")).join(
        flooded, "GEOID", "left_semi"
    )
    # stacked tracts of a county are one place, and a school there counts once
    places = once(tracts.select(county_key().alias("county_geoid"), "geometry"), "geometry", ["county_geoid"])
    inside = spatial_join(_schools(layers), places, "within", a_geom=XY)
    joined = inside.join(_county_names(layers, "22"), "county_geoid")
    return top_n(joined, ["county_name"], F.count_distinct("SCHOOL_ID"), 5)


def _svi_of_point_tracts(name, points, key, point_where, tracts_where, column, alias):
    @query(
        name,
        "WITH " + _sql_points(points, "census_tracts", "inside", f"p.{key}, g.GEOID",
                              f"{point_where} AND {tracts_where} AND g.valid")
        + f" SELECT ROUND(AVG(v.{column}), 6) AS {alias} FROM inside h JOIN svi v ON h.GEOID = v.GEOID"
        f" WHERE v.{column} IS NOT NULL AND v.{column} BETWEEN 0 AND 100",
    )
    def run(layers):
        rows = layers[points].where(point_where.replace("p.", "")).select(key, *XY)
        tracts = _polygons(layers, "census_tracts", "GEOID", where=tracts_where.replace("g.", ""))
        hosting = partner_counts(tracts, rows, "contains", b_geom=XY)
        counts = hosting.groupBy("GEOID").agg(F.sum("n_partners").alias("n"))
        values = layers["svi"].where(F.col(column).isNotNull() & F.col(column).between(0, 100))
        joined = values.join(counts, "GEOID")
        return joined.agg(F.round(weighted_avg(F.col(column), F.col("n")), 6).alias(alias))


_svi_of_point_tracts("point_in_polygon_avg", "hospitals", "HOSPITAL_ID", "p.STATEFP = '12'", "TRUE",
                     "SPL_THEME1", "avg_svi_theme1")
_svi_of_point_tracts("school_tract_housing_avg", "schools", "SCHOOL_ID", "TRUE", "LEFT(g.GEOID, 5) = '22007'",
                     "RPL_THEME4", "avg_housing_vulnerability")
_svi_of_point_tracts("school_tract_overall_avg", "schools", "SCHOOL_ID", "TRUE", "LEFT(g.GEOID, 5) = '48010'",
                     "RPL_THEMES", "avg_overall_vulnerability")


@query(
    "hospital_tract_max_claim",
    "WITH " + _sql_points("hospitals", "census_tracts", "inside", "DISTINCT g.GEOID", "p.STATEFP = '22' AND g.valid")
    + " SELECT MAX(CAST(cl.amountPaidOnContentsClaim AS DOUBLE)) AS max_building_claim"
    " FROM inside h JOIN claims cl ON cl.GEOID = h.GEOID WHERE cl.amountPaidOnContentsClaim IS NOT NULL",
)
def hospital_tract_max_claim(layers):
    """A maximum does not care how often a tract is repeated: semi joins suffice."""
    tracts = _polygons(layers, "census_tracts", "GEOID")
    hosting = spatial_join(
        tracts, _hospitals(layers, where=F.col("STATEFP") == "22"), "contains", "left_semi",
        b_geom=XY, left_key="GEOID",
    )
    claims = layers["claims"].join(hosting.select("GEOID"), "GEOID", "left_semi")
    return claims.agg(
        F.max(F.col("amountPaidOnContentsClaim").cast("double")).alias("max_building_claim")
    )


@query(
    "nested_exists_spatial",
    "WITH wet AS (SELECT DISTINCT z.GEOID FROM zcta z JOIN floodplain f ON "
    + s.boxes("z", "f") + " WHERE z.valid AND f.valid AND " + s.intersects("z", "f") + "), "
    + _sql_points("schools", "zcta", "wet_schools", "DISTINCT p.SCHOOL_ID", "g.GEOID IN (SELECT GEOID FROM wet)")
    + ", " + _sql_points("schools", "county", "inside", "p.SCHOOL_ID, g.NAME", "g.STATEFP = '22' AND g.valid")
    + " SELECT c.NAME AS county_name FROM inside c WHERE c.SCHOOL_ID IN (SELECT SCHOOL_ID FROM wet_schools)"
    " GROUP BY c.NAME ORDER BY COUNT(*) DESC, c.NAME LIMIT 2",
)
def nested_exists_spatial(layers):
    areas = _polygons(layers, "zcta", F.col("GEOID").alias("zcta_geoid"), geom="zcta_geom")
    wet = spatial_join(
        areas, _floods(layers), "intersects", "left_semi",
        a_geom="zcta_geom", b_geom="flood_geom", left_key="zcta_geoid",
    )
    schools = spatial_join(
        _schools(layers), wet, "within", "left_semi", a_geom=XY, b_geom="zcta_geom", b_layer=areas
    )
    county = _polygons(
        layers, "county", F.col("NAME").alias("county_name"), where="STATEFP = '22'"
    )
    inside = spatial_join(schools, county, "within", a_geom=XY, a_layer=layers["schools"])
    return top_n(inside, ["county_name"], row_count(), 2)


@query(
    "hospitals_in_floods_crossing_tracts",
    _sql_pairs("TRUE")
    + ", " + _sql_points("hospitals", "floodplain", "inside", "p.HOSPITAL_ID, p.COUNTYFIPS, g.GFID", "g.valid")
    + " SELECT c.NAME AS county_name FROM inside h JOIN county c ON LEFT(h.COUNTYFIPS, 5) = c.GEOID"
    " WHERE c.STATEFP = '12' AND h.GFID IN (SELECT GFID FROM pairs)"
    " GROUP BY c.NAME ORDER BY COUNT(DISTINCT h.HOSPITAL_ID) DESC, c.NAME LIMIT 5",
)
def hospitals_in_floods_crossing_tracts(layers):
    tracts = _polygons(layers, "census_tracts", geom="tract_geom")
    crossing = spatial_join(
        _floods(layers), tracts, "intersects", "left_semi",
        a_geom="flood_geom", b_geom="tract_geom", left_key="GFID",
    )
    rows = _hospitals(
        layers, F.left("COUNTYFIPS", F.lit(5)).alias("county_geoid"), where=has_prefix("COUNTYFIPS", "12")
    )
    inside = spatial_join(
        rows, crossing, "within", "left_semi", a_geom=XY, b_geom="flood_geom", b_layer=_floods(layers)
    )
    joined = inside.join(_county_names(layers, "12"), "county_geoid")
    return top_n(joined, ["county_name"], F.count_distinct("HOSPITAL_ID"), 5)


@query(
    "mixed_key_and_containment",
    "WITH " + _sql_points("schools", "county", "inside", "p.SCHOOL_ID, g.NAME",
                          "p.STATEFP = g.STATEFP AND g.STATEFP = '48' AND g.valid")
    + ", " + _sql_points("schools", "floodplain", "wet", "DISTINCT p.SCHOOL_ID", "g.valid")
    + " SELECT c.NAME AS county_name FROM inside c WHERE c.SCHOOL_ID IN (SELECT SCHOOL_ID FROM wet)"
    " GROUP BY c.NAME ORDER BY COUNT(DISTINCT c.SCHOOL_ID) DESC, c.NAME LIMIT 5",
)
def mixed_key_and_containment(layers):
    """State equality goes into the grid key, so both sides filter on it."""
    rows = _schools(layers, F.left("STATEFP", F.lit(2)).alias("school_state"), where="STATEFP = '48'")
    # the large layer first: a semi join keeps the size estimate of the schools
    wet = spatial_join(rows, _floods(layers), "within", "left_semi", a_geom=XY, b_geom="flood_geom")
    county = _polygons(
        layers, "county", "STATEFP", F.col("NAME").alias("county_name"), where="STATEFP = '48'"
    )
    inside = spatial_join(
        wet, county, "within", a_geom=XY, partition_keys=[("school_state", "STATEFP")], a_layer=rows
    )
    return top_n(inside, ["county_name"], F.count_distinct("SCHOOL_ID"), 5)


@query(
    "county_loss_if_hospital",
    "WITH " + _sql_points("hospitals", "county", "inside", "DISTINCT g.GEOID", "g.GEOID = '48015'")
    + " SELECT ROUND(SUM(n.RFLD_EALB), 6) AS total_expected_loss FROM nri n JOIN inside c"
    " ON LEFT(n.GEOID, 5) = c.GEOID WHERE n.RFLD_EALB IS NOT NULL",
)
def county_loss_if_hospital(layers):
    county = _polygons(layers, "county", "GEOID", valid=False, where=F.col("GEOID") == "48015")
    hosting = spatial_join(
        county, _hospitals(layers), "contains", "left_semi", b_geom=XY, left_key="GEOID"
    ).select(F.col("GEOID").alias("county_geoid"))
    known = F.col("RFLD_EALB").isNotNull() & has_prefix("GEOID", "48015")
    rows = layers["nri"].where(known).withColumn("county_geoid", county_key())
    return rows.join(hosting, "county_geoid", "left_semi").agg(
        F.round(F.sum("RFLD_EALB"), 6).alias("total_expected_loss")
    )


@query(
    "hospital_tract_population_avg",
    "WITH " + _sql_points("hospitals", "census_tracts", "inside", "DISTINCT g.GEOID", "LEFT(g.GEOID, 5) = '22007'")
    + " SELECT ROUND(AVG(v.E_TOTPOP), 6) AS avg_population_in_hospital_tracts FROM inside t"
    " JOIN svi v ON t.GEOID = v.GEOID WHERE v.E_TOTPOP IS NOT NULL",
)
def hospital_tract_population_avg(layers):
    tracts = _polygons(layers, "census_tracts", "GEOID", valid=False, where=has_prefix("GEOID", "22007"))
    hosting = spatial_join(
        tracts, _hospitals(layers), "contains", "left_semi", b_geom=XY, left_key="GEOID"
    )
    values = layers["svi"].where(F.col("E_TOTPOP").isNotNull() & has_prefix("GEOID", "22007"))
    return values.join(hosting.select("GEOID"), "GEOID", "left_semi").agg(
        F.round(F.avg("E_TOTPOP"), 6).alias("avg_population_in_hospital_tracts")
    )


@query(
    "point_in_two_polygons",
    "WITH " + _sql_points("hospitals", "floodplain", "wet", "DISTINCT p.UNIQUE_ID", "g.valid")
    + ", " + _sql_points("hospitals", "census_tracts", "inside", "DISTINCT p.UNIQUE_ID", "g.valid AND LEFT(g.GEOID, 2) = '48'")
    + " SELECT COUNT(DISTINCT UNIQUE_ID) AS num_hospitals FROM wet WHERE UNIQUE_ID IN (SELECT UNIQUE_ID FROM inside)",
)
def point_in_two_polygons(layers):
    tracts = _polygons(layers, "census_tracts", where=has_prefix("GEOID", "48"), geom="tract_geom")
    inside = spatial_join(
        _hospitals(layers, "UNIQUE_ID"), tracts, "within", "left_semi", a_geom=XY, b_geom="tract_geom"
    )
    wet = spatial_join(
        inside, _floods(layers), "within", "left_semi",
        a_geom=XY, b_geom="flood_geom", a_layer=layers["hospitals"],
    )
    return wet.agg(F.count_distinct("UNIQUE_ID").alias("num_hospitals"))


@query(
    "dry_hospitals",
    "WITH " + _sql_points("hospitals", "floodplain", "wet", "DISTINCT p.HOSPITAL_ID", "g.valid")
    + " SELECT COUNT(*) AS num_dry FROM hospitals WHERE HOSPITAL_ID NOT IN (SELECT HOSPITAL_ID FROM wet)",
)
def dry_hospitals(layers):
    """Spatial anti-join; hospitals without coordinates are kept."""
    dry = spatial_join(
        _hospitals(layers), _floods(layers), "within", "left_anti", a_geom=XY, b_geom="flood_geom"
    )
    return dry.agg(row_count().alias("num_dry"))


def _same_state(layers, how):
    rows = layers["hospitals"].select("HOSPITAL_ID", "STATEFP", *XY)
    floods = _polygons(layers, "floodplain", "STATEFP", geom="flood_geom")
    kept = spatial_join(
        rows, floods, "within", how, a_geom=XY, b_geom="flood_geom", partition_keys=[("STATEFP", "STATEFP")]
    )
    return kept.groupBy("STATEFP").agg(row_count().alias("num_hospitals"))


_SAME_STATE = "WITH " + _sql_points(
    "hospitals", "floodplain", "wet", "DISTINCT p.HOSPITAL_ID", "g.valid AND g.STATEFP = p.STATEFP"
)


@query(
    "semi_partition_keys",
    _SAME_STATE + " SELECT STATEFP, COUNT(*) AS num_hospitals FROM hospitals"
    " WHERE HOSPITAL_ID IN (SELECT HOSPITAL_ID FROM wet) GROUP BY STATEFP",
)
def semi_partition_keys(layers):
    """Hospitals in a floodplain of their own state; both sides have a column STATEFP."""
    return _same_state(layers, "left_semi")


@query(
    "anti_partition_keys",
    _SAME_STATE + " SELECT STATEFP, COUNT(*) AS num_hospitals FROM hospitals"
    " WHERE HOSPITAL_ID NOT IN (SELECT HOSPITAL_ID FROM wet) GROUP BY STATEFP",
)
def anti_partition_keys(layers):
    return _same_state(layers, "left_anti")


# -- one query per spatial rule of the catalog ---------------------------------------

def _point_rule(points, polygons):
    key = {"hospitals": "HOSPITAL_ID", "schools": "SCHOOL_ID"}[points]
    group = "GFID" if polygons == "floodplain" else "GEOID"

    @query(
        f"spatial_rule_{points}_{polygons}",
        "WITH " + _sql_points(points, polygons, "inside", f"p.{key}, g.{group} AS key", "g.valid")
        + " SELECT key, COUNT(*) AS num_points FROM inside GROUP BY key",
    )
    def run(layers):
        rows = layers[points].select(key, *XY)
        areas = _polygons(layers, polygons, F.col(group).alias("key"))
        hosting = join_layers(areas, polygons, rows, points, predicate="contains", counted="num_points")
        return hosting.groupBy("key").agg(F.sum("num_points").alias("num_points"))


def _polygon_rule(a, b):
    group = "GFID" if a == "floodplain" else "GEOID"

    @query(
        f"spatial_rule_{a}_{b}",
        f"SELECT a.{group} AS key, COUNT(*) AS num_partners FROM {a} a JOIN {b} b ON {s.boxes('a', 'b')}"
        f" WHERE a.valid AND b.valid AND {s.intersects('a', 'b')} GROUP BY a.{group}",
    )
    def run(layers):
        left = _polygons(layers, a, F.col(group).alias("key"))
        right = _polygons(layers, b)
        counted = join_layers(left, a, right, b, predicate="intersects", counted="num_partners")
        return counted.groupBy("key").agg(F.sum("num_partners").alias("num_partners"))


for _left, _right in JOIN_RULES["point_polygon"]:
    _point_rule(_layer_of(_left), _layer_of(_right))
for _left, _right in JOIN_RULES["polygon_polygon"]:
    _polygon_rule(_layer_of(_left), _layer_of(_right))


# -- polygon measures and predicates ---------------------------------------------------

def _pair_sql(a, b, condition, columns, tail=""):
    return (
        f"SELECT {columns} FROM (SELECT a.GEOID AS a_key, a.edges AS a_edges,"
        f" {'b.GFID' if b == 'floodplain' else 'b.GEOID'} AS b_key, b.edges AS b_edges,"
        f" {s.overlap_area('a', 'b')} AS shared, {s.area('a.edges')} AS area_a, {s.area('b.edges')} AS area_b,"
        f" {s.intersects('a', 'b')} AS met FROM {a} a JOIN {b} b ON {s.boxes('a', 'b')}"
        f" WHERE a.valid AND b.valid) WHERE {condition} {tail}"
    )


def _tracts(layers, key="GEOID", geom="tract_geom", where=None):
    return _polygons(layers, "census_tracts", F.col("GEOID").alias(key), geom=geom, where=where)


def _zctas(layers):
    return _polygons(layers, "zcta", F.col("GEOID").alias("zcta_geoid"), geom="zcta_geom")


OVERLAPS = "shared > 0 AND shared < least(area_a, area_b)"


@query(
    "overlap_area_topn",
    _pair_sql("census_tracts", "zcta", f"{OVERLAPS} AND a_key LIKE '12%'", "a_key AS census_tracts_id",
              "GROUP BY a_key ORDER BY SUM(shared) DESC, a_key LIMIT 5"),
)
def overlap_area_topn(layers):
    pairs = partner_counts(
        _tracts(layers, "census_tracts_id", where="STATEFP = '12'"), _zctas(layers), "overlaps",
        a_geom="tract_geom", b_geom="zcta_geom", overlap_area="shared",
    )
    return top_n(pairs, ["census_tracts_id"], F.sum("shared"), 5)


@query(
    "zcta_flood_overlap_area",
    f"SELECT b.GEOID AS zcta_geoid, COUNT(*) AS num_floods, ROUND(SUM({s.overlap_area('a', 'b')}), 6) AS shared_area"
    f" FROM floodplain a JOIN zcta b ON {s.boxes('a', 'b')} WHERE a.valid AND b.valid"
    f" AND {s.overlap_area('a', 'b')} > 0 AND {s.overlap_area('a', 'b')} < least({s.area('a.edges')}, {s.area('b.edges')})"
    " GROUP BY b.GEOID",
)
def zcta_flood_overlap_area(layers):
    """Overlap magnitude per area; stacked floodplains add up."""
    pairs = partner_counts(
        _zctas(layers), _floods(layers), "overlaps",
        a_geom="zcta_geom", b_geom="flood_geom", overlap_area="shared",
    )
    return pairs.groupBy("zcta_geoid").agg(
        F.sum("n_partners").alias("num_floods"), F.round(F.sum("shared"), 6).alias("shared_area")
    )


@query(
    "coverage_share",
    _pair_sql("census_tracts", "floodplain", "met", "a_key AS GEOID, ROUND(SUM(shared) / ANY_VALUE(area_a), 6) AS share",
              "GROUP BY a_key"),
)
def flood_coverage(layers):
    pairs = partner_counts(
        _tracts(layers), _floods(layers), "intersects",
        a_geom="tract_geom", b_geom="flood_geom", overlap_area="shared",
    )
    shares = coverage_share(pairs, ["GEOID"], "tract_geom", "shared")
    return shares.withColumn("share", F.round("share", 6))


def _tract_pairs(name, predicate, condition):
    @query(
        name,
        _pair_sql("census_tracts", "census_tracts", f"a_key < b_key AND {condition}", "a_key AS tract_a, b_key AS tract_b"),
    )
    def run(layers):
        left, right = _tracts(layers, "tract_a", "geom_a"), _tracts(layers, "tract_b", "geom_b")
        pairs = spatial_join(left, right, predicate, a_geom="geom_a", b_geom="geom_b", copies_once=True)
        return pairs.where("tract_a < tract_b").select("tract_a", "tract_b")


_tract_pairs("touching_neighbours", "touches", "met AND shared = 0")
_tract_pairs("polygon_equals", "equals", "shared = area_a AND shared = area_b")


@query(
    "polygon_contains",
    _pair_sql("county", "floodplain", "shared = area_b", "a_key AS county_geoid, COUNT(*) AS num_inside",
              "GROUP BY a_key"),
)
def polygon_contains(layers):
    county = _polygons(layers, "county", F.col("GEOID").alias("county_geoid"), geom="county_geom")
    counted = partner_counts(county, _floods(layers), "contains", a_geom="county_geom", b_geom="flood_geom")
    return counted.groupBy("county_geoid").agg(F.sum("n_partners").alias("num_inside"))


@query(
    "polygon_within",
    _pair_sql("census_tracts", "zcta", "shared = area_a", "a_key AS GEOID, b_key AS zcta_geoid"),
)
def polygon_within(layers):
    pairs = spatial_join(
        _tracts(layers), _zctas(layers), "within", a_geom="tract_geom", b_geom="zcta_geom"
    )
    return pairs.select("GEOID", "zcta_geoid")


@query(
    "three_polygon_chain",
    "WITH tz AS (" + _pair_sql("census_tracts", "zcta", OVERLAPS, "DISTINCT a_key, b_key") + "), "
    "tf AS (" + _pair_sql("census_tracts", "floodplain", "met", "a_key, b_key") + ")"
    " SELECT tz.b_key AS zcta_geoid, COUNT(*) AS num_rows, COUNT(DISTINCT tf.b_key) AS num_floods"
    " FROM tz JOIN tf ON tz.a_key = tf.a_key GROUP BY tz.b_key",
)
def three_polygon_chain(layers):
    """Tracts that overlap a ZIP area, and the floodplains they meet.

    Every different outline is joined once; the tracts of one are a weight, and the floodplains get back to their rows
    before they are counted.
    """
    tracts = once(_tracts(layers), "tract_geom", count="n_tracts").withColumns(code("tract_geom"))
    by_tract = [*code("tract_geom")]
    floods = _floods(layers)
    codes = {f"flood{i}": c for i, c in enumerate(code("flood_geom").values())}
    overlapping = spatial_join(
        tracts, _zctas(layers), "overlaps", a_geom="tract_geom", b_geom="zcta_geom"
    ).select(*by_tract, "n_tracts", "zcta_geoid")
    met = spatial_join(
        tracts, once(floods, "flood_geom").withColumns(codes), "intersects", a_geom="tract_geom", b_geom="flood_geom"
    ).select(*by_tract, *codes)
    chain = overlapping.join(met, by_tract).groupBy("zcta_geoid", *codes).agg(F.sum("n_tracts").alias("n_tracts"))
    # by merging: on disk the rows look smaller than they are, with so few columns the more so
    rows = floods.select("GFID", *[c.alias(n) for n, c in codes.items()]).join(chain.hint("merge"), [*codes])
    return rows.groupBy("zcta_geoid").agg(
        F.sum("n_tracts").alias("num_rows"), F.count_distinct("GFID").alias("num_floods")
    )


@query(
    "within_distance",
    "SELECT h.HOSPITAL_ID, s.SCHOOL_ID, ROUND(sqrt((h.LON - s.LON) * (h.LON - s.LON)"
    " + (h.LAT - s.LAT) * (h.LAT - s.LAT)), 6) AS distance FROM hospitals h JOIN schools s"
    " ON s.LON BETWEEN h.LON - 0.0625 AND h.LON + 0.0625 AND s.LAT BETWEEN h.LAT - 0.0625 AND h.LAT + 0.0625"
    " WHERE sqrt((h.LON - s.LON) * (h.LON - s.LON) + (h.LAT - s.LAT) * (h.LAT - s.LAT)) <= 0.0625",
)
def within_distance(layers):
    schools = layers["schools"].select(
        "SCHOOL_ID", F.col("LON").alias("school_lon"), F.col("LAT").alias("school_lat")
    )
    pairs = distance_join(
        _hospitals(layers), schools, 0.0625, a_geom=XY, b_geom=("school_lon", "school_lat")
    )
    return pairs.select("HOSPITAL_ID", "SCHOOL_ID", F.round("distance", 6).alias("distance"))


def _edge_distance_sql():
    dx, dy = "(p.bx - p.ax)", "(p.by - p.ay)"
    t = f"greatest(0, least(1, ((h.LON - p.ax) * {dx} + (h.LAT - p.ay) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    gx, gy = f"(p.ax + {t} * {dx} - h.LON)", f"(p.ay + {t} * {dy} - h.LAT)"
    return (
        f"CASE WHEN {s.covers('t.edges', 'h.LON', 'h.LAT')} THEN 0"
        f" ELSE sqrt(list_min(list_transform(t.edges, lambda p: {gx} * {gx} + {gy} * {gy}))) END"
    )


@query(
    "tracts_near_hospitals",
    "SELECT GEOID, COUNT(*) AS num_near, ROUND(MIN(distance), 6) AS nearest FROM (SELECT t.GEOID, "
    f"{_edge_distance_sql()} AS distance FROM census_tracts t JOIN hospitals h"
    " ON h.LON BETWEEN t.xmin - 0.25 AND t.xmax + 0.25 AND h.LAT BETWEEN t.ymin - 0.25 AND t.ymax + 0.25)"
    " WHERE distance <= 0.25 GROUP BY GEOID",
)
def tracts_near_hospitals(layers):
    """Distance from polygons to points, zero inside."""
    tracts = _polygons(layers, "census_tracts", "GEOID", valid=False, geom="tract_geom")
    near = near_counts(tracts, _hospitals(layers), 0.25, a_geom="tract_geom", b_geom=XY)
    return near.groupBy("GEOID").agg(
        F.sum("n_near").alias("num_near"), F.round(F.min("nearest"), 6).alias("nearest")
    )
