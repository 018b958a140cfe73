"""Single-layer questions: filters, aggregates, measures and top-N on one layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import has_prefix
from ..operators.aggregates import annual_mean, extent, top_n
from ..sources.layers import sample_rows
from . import sql as s
from .layers import POLYGON_KEYS
from .registry import query


def measured(layer: DataFrame) -> DataFrame:
    """Polygon layer with area, valid and bounds as plain columns; what a query
    does not use is pruned."""
    box = F.col("geometry")
    return layer.withColumns(
        {
            "area": g.polygon_area("geometry"),
            "valid": box["valid"],
            **{c: box[c] for c in ("xmin", "ymin", "xmax", "ymax")},
        }
    )


def _relation(layers, name):
    return measured(layers[name]) if name in POLYGON_KEYS else layers[name]


def _sql_relation(name):
    return f"(SELECT *, {s.area('edges')} AS area FROM {name}) AS t" if name in POLYGON_KEYS else name


def scalar(name: str, layer: str, measure: str, alias: str, where: str = "TRUE") -> None:
    """Register a one-row aggregate; measure and condition read the same in both engines."""

    @query(name, f"SELECT {measure} AS {alias} FROM {_sql_relation(layer)} WHERE {where}")
    def run(layers):
        return _relation(layers, layer).where(where).agg(F.expr(measure).alias(alias))


def _avg(c):
    return f"ROUND(AVG({c}), 6)"


def _sum(c, digits=6):
    return f"ROUND(SUM({c}), {digits})"


def _dbl(c):
    return f"CAST({c} AS DOUBLE)"


BUILDING = "amountPaidOnBuildingClaim"
CONTENTS = "amountPaidOnContentsClaim"
COMPLIANCE = "amountPaidOnIncreasedCostOfComplianceClaim"

# -- claims ------------------------------------------------------------------

scalar("count_prefix_date", "claims", "COUNT(*)", "num_claims",
       "GEOID LIKE '48010%' AND dateOfLoss >= DATE '1998-01-01'")
scalar("count_prefix", "claims", "COUNT(*)", "num_claims", "GEOID LIKE '48%'")
scalar("count_before_date", "claims", "COUNT(*)", "num_old_claims",
       "GEOID LIKE '48%' AND dateOfLoss < DATE '1996-06-01'")
scalar("count_between_dates", "claims", "COUNT(*)", "num_claims",
       "GEOID LIKE '12%' AND dateOfLoss BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
scalar("count_missing_date", "claims", "COUNT(*)", "num_missing_date",
       "GEOID LIKE '22%' AND dateOfLoss IS NULL")
scalar("avg_nonnull_payout", "claims", _avg(_dbl(BUILDING)), "avg_building_payout",
       f"GEOID LIKE '22%' AND {BUILDING} IS NOT NULL")
scalar("avg_payout_everywhere", "claims", _avg(_dbl(BUILDING)), "avg_payout", f"{BUILDING} IS NOT NULL")
scalar("max_contents_payout", "claims", f"MAX({_dbl(CONTENTS)})", "max_contents_payout",
       f"GEOID LIKE '12%' AND {CONTENTS} IS NOT NULL")
scalar("zero_icc_count", "claims", "COUNT(*)", "num_zero_icc",
       f"GEOID LIKE '48%' AND {COMPLIANCE} IS NOT NULL AND {_dbl(COMPLIANCE)} = 0")
scalar("min_date", "claims", "MIN(dateOfLoss)", "earliest_date", "GEOID LIKE '12%'")
scalar("sum_building_payout", "claims", _sum(_dbl(BUILDING), 2), "total_building",
       f"GEOID LIKE '22%' AND {BUILDING} IS NOT NULL")
scalar("avg_row_ratio", "claims", _avg(f"{_dbl(BUILDING)} / {_dbl(CONTENTS)}"), "avg_ratio",
       f"GEOID LIKE '22%' AND {BUILDING} IS NOT NULL AND {CONTENTS} IS NOT NULL AND {_dbl(CONTENTS)} > 0")

# -- floodplain --------------------------------------------------------------

scalar("sum_area_valid_zone", "floodplain", _sum("area"), "total_ae_area",
       "STATEFP = '12' AND FLD_ZONE = 'AE' AND valid")
scalar("sum_area_flood_zones", "floodplain", _sum("area"), "total_flood_area",
       "FLD_ZONE NOT IN ('X', 'AREA NOT INCLUDED') AND valid")
scalar("sum_area_state", "floodplain", _sum("area"), "total_area", "STATEFP = '48' AND valid")
scalar("max_area", "floodplain", "MAX(area)", "max_area", "STATEFP = '22' AND valid")
scalar("count_distinct_zones", "floodplain", "COUNT(DISTINCT FLD_ZONE)", "num_zones")
scalar("invalid_polygons", "floodplain", "COUNT(*)", "num_invalid", "NOT valid")

# -- boundaries --------------------------------------------------------------

scalar("avg_area_county_tracts", "census_tracts", _avg("area"), "avg_area",
       "STATEFP = '12' AND COUNTYFP = '006' AND valid")
scalar("avg_area_tracts", "census_tracts", _avg("area"), "avg_area", "valid")
scalar("count_zctas", "zcta", "COUNT(*)", "num_zctas", "STATEFP = '22'")
scalar("count_large_zctas", "zcta", "COUNT(*)", "num_large_zctas", "STATEFP = '48' AND area > 0.5 AND valid")
scalar("avg_area_zctas", "zcta", _avg("area"), "avg_area", "STATEFP = '12' AND valid")
scalar("bbox_filter", "county", "COUNT(*)", "num_west_counties", "STATEFP = '12' AND xmax < 9 AND ymin > 1 AND valid")
scalar("avg_area_counties", "county", _avg("area"), "avg_area", "STATEFP = '48' AND valid")

# -- facilities --------------------------------------------------------------

scalar("count_hospitals_west", "hospitals", "COUNT(*)", "num_hospitals_west",
       "STATEFP = '22' AND LON < 9.5 AND LON IS NOT NULL")
scalar("count_schools_south", "schools", "COUNT(*)", "num_schools_south",
       "STATEFP = '12' AND LAT < 7.5 AND LAT IS NOT NULL")
scalar("min_longitude", "schools", "MIN(LON)", "min_lon", "STATEFP = '48' AND LON IS NOT NULL")
scalar("max_latitude", "hospitals", "MAX(LAT)", "max_lat", "STATEFP = '12' AND LAT IS NOT NULL")
scalar("count_distinct_nonnull", "hospitals", "COUNT(DISTINCT CITY)", "num_cities",
       "STATEFP = '22' AND CITY IS NOT NULL")
scalar("null_coordinate_count", "schools", "COUNT(*)", "num_missing",
       "STATEFP = '22' AND (LAT IS NULL OR LON IS NULL)")
scalar("count_city_upper", "hospitals", "COUNT(*)", "num_in_city", "CITY = 'MACHINERY 7'")

# -- tract indicators --------------------------------------------------------

scalar("sum_riverine_loss", "nri", _sum("RFLD_EALB"), "total_riverine_loss",
       "GEOID LIKE '48010%' AND RFLD_EALB IS NOT NULL")
scalar("avg_flood_frequency", "nri", _avg("RFLD_AFREQ"), "avg_flood_frequency",
       "GEOID LIKE '48%' AND RFLD_AFREQ IS NOT NULL")
scalar("avg_coastal_loss_population", "nri", _avg("CFLD_EALP"), "avg_cfld_ealp",
       "GEOID LIKE '48005%' AND CFLD_EALP IS NOT NULL")
scalar("avg_coastal_risk", "nri", _avg("CFLD_RISKS"), "avg_coastal_risk",
       "GEOID LIKE '12%' AND CFLD_RISKS IS NOT NULL")
scalar("avg_pred3_pe", "cre", _avg("PRED3_PE"), "avg_pred3_pe", "GEOID LIKE '48%' AND PRED3_PE IS NOT NULL")
scalar("avg_pred12_pe", "cre", _avg("PRED12_PE"), "avg_pred12_pe", "GEOID LIKE '12%' AND PRED12_PE IS NOT NULL")
scalar("max_pred12_e", "cre", f"MAX({_dbl('PRED12_E')})", "max_pred12_e",
       "GEOID LIKE '12%' AND PRED12_E IS NOT NULL")
scalar("avg_population_universe", "cre", _avg("POPUNI"), "average_popuni", "GEOID LIKE '22%'")
scalar("percent_case", "cre",
       "ROUND(CAST(100 AS DOUBLE) * SUM(CASE WHEN WATER_TRACT = 1 THEN 1 ELSE 0 END) / COUNT(*), 6)",
       "pct_with_water", "LEFT(GEOID, 5) = '12011'")
scalar("percent_distinct_case", "cre",
       "ROUND(CAST(100 AS DOUBLE) * COUNT(DISTINCT CASE WHEN WATER_TRACT = 1 THEN GEOID END)"
       " / COUNT(DISTINCT GEOID), 6)",
       "pct_with_water", "GEOID LIKE '48%'")
scalar("fraction_over", "svi",
       "ROUND(CAST(SUM(CASE WHEN EP_NOINT > 20 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6)",
       "frac_high_no_internet", "GEOID LIKE '48%' AND EP_NOINT IS NOT NULL")
scalar("sum_households_by_fips", "svi", _sum(_dbl("E_HH")), "total_households",
       "CAST(FIPS AS STRING) LIKE '12%' AND E_HH IS NOT NULL")
scalar("max_population", "svi", f"MAX({_dbl('E_TOTPOP')})", "max_pop", "GEOID LIKE '22%' AND E_TOTPOP IS NOT NULL")
scalar("avg_population", "svi", _avg(_dbl("E_TOTPOP")), "avg_pop", "GEOID LIKE '48%' AND E_TOTPOP IS NOT NULL")
scalar("count_svi_records", "svi", "COUNT(*)", "num_records", "GEOID LIKE '48%'")
scalar("avg_valid_percentile", "svi", _avg("RPL_THEMES"), "avg_rank",
       "RPL_THEMES IS NOT NULL AND RPL_THEMES BETWEEN 0 AND 100")


# -- ranking -----------------------------------------------------------------

@query(
    "topn_by_expr",
    "SELECT GEOID FROM cre WHERE GEOID LIKE '22%' AND POPUNI IS NOT NULL"
    " ORDER BY CAST(POPUNI AS DOUBLE) DESC, GEOID LIMIT 5",
)
def topn_by_expr(layers):
    rows = layers["cre"].where(has_prefix("GEOID", "22") & F.col("POPUNI").isNotNull())
    return rows.orderBy(F.col("POPUNI").cast("double").desc(), "GEOID").limit(5).select("GEOID")


@query(
    "topn_by_hidden_count",
    "SELECT COUNTYFP FROM census_tracts WHERE STATEFP = '22' GROUP BY COUNTYFP"
    " ORDER BY COUNT(*) DESC, COUNTYFP LIMIT 1",
)
def topn_by_hidden_count(layers):
    rows = layers["census_tracts"].where(F.col("STATEFP") == "22")
    return top_n(rows, ["COUNTYFP"], F.count(F.lit(1)), 1)


@query(
    "top_risk_ratings",
    "SELECT RFLD_RISKR FROM nri WHERE GEOID LIKE '22%' GROUP BY RFLD_RISKR"
    " ORDER BY COUNT(*) DESC, RFLD_RISKR LIMIT 3",
)
def top_risk_ratings(layers):
    return top_n(layers["nri"].where(has_prefix("GEOID", "22")), ["RFLD_RISKR"], F.count(F.lit(1)), 3)


@query(
    "top_flood_state",
    "SELECT STATEFP FROM floodplain WHERE valid GROUP BY STATEFP ORDER BY COUNT(*) DESC, STATEFP LIMIT 1",
)
def top_flood_state(layers):
    return top_n(layers["floodplain"].where("geometry.valid"), ["STATEFP"], F.count(F.lit(1)), 1)


@query(
    "top_city_of_type",
    "SELECT CITY FROM schools WHERE TYPE = 'ECONOMY' GROUP BY CITY ORDER BY COUNT(*) DESC, CITY LIMIT 1",
)
def top_city_of_type(layers):
    return top_n(layers["schools"].where(F.col("TYPE") == "ECONOMY"), ["CITY"], F.count(F.lit(1)), 1)


@query(
    "smallest_area_key",
    f"SELECT GFID FROM floodplain WHERE STATEFP = '22' ORDER BY {s.area('edges')}, GFID LIMIT 1",
)
def smallest_area_key(layers):
    rows = measured(layers["floodplain"]).where(F.col("STATEFP") == "22")
    return rows.orderBy("area", "GFID").limit(1).select("GFID")


@query(
    "offset_second",
    "SELECT GEOID FROM cre ORDER BY POPUNI DESC, GEOID LIMIT 1 OFFSET 1",
)
def offset_second(layers):
    return layers["cre"].orderBy(F.desc("POPUNI"), "GEOID").offset(1).limit(1).select("GEOID")


@query(
    "having_threshold",
    "SELECT GEOID, COUNT(*) AS num_claims FROM claims GROUP BY GEOID HAVING COUNT(*) > 600",
)
def having_threshold(layers):
    counts = layers["claims"].groupBy("GEOID").agg(F.count(F.lit(1)).alias("num_claims"))
    return counts.where(F.col("num_claims") > 600)


@query(
    "nested_mean_of_ratios",
    "SELECT ROUND(AVG(ratio), 6) AS mean_ratio FROM (SELECT LEFT(GEOID, 5) AS county_geoid,"
    " CAST(SUM(CASE WHEN EP_MINRTY > 50 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS ratio FROM svi"
    " WHERE EP_MINRTY BETWEEN 0 AND 100 GROUP BY 1)",
)
def nested_mean_of_ratios(layers):
    """Mean over counties of a per-county share."""
    rows = layers["svi"].where(F.col("EP_MINRTY").between(0, 100))
    per_county = rows.groupBy(F.left("GEOID", F.lit(5)).alias("county_geoid")).agg(
        F.avg((F.col("EP_MINRTY") > 50).cast("double")).alias("ratio")
    )
    return per_county.agg(F.round(F.avg("ratio"), 6).alias("mean_ratio"))


# -- dates -------------------------------------------------------------------

_ANNUAL = (
    "ROUND(CAST(COUNT(dateOfLoss) AS DOUBLE) / (MAX(EXTRACT(YEAR FROM dateOfLoss))"
    " - MIN(EXTRACT(YEAR FROM dateOfLoss)) + 1), 6)"
)


@query("annual_mean", f"SELECT GEOID, {_ANNUAL} AS annual_mean FROM claims GROUP BY GEOID HAVING COUNT(dateOfLoss) > 0")
def annual_claims(layers):
    dated = layers["claims"].where(F.col("dateOfLoss").isNotNull())
    means = annual_mean(dated, "dateOfLoss", ["GEOID"])
    return means.withColumn("annual_mean", F.round("annual_mean", 6))


@query(
    "claims_per_month",
    "SELECT CAST(EXTRACT(YEAR FROM dateOfLoss) AS INTEGER) AS loss_year,"
    " CAST(EXTRACT(MONTH FROM dateOfLoss) AS INTEGER) AS loss_month, COUNT(*) AS num_claims"
    " FROM claims WHERE dateOfLoss IS NOT NULL GROUP BY 1, 2",
)
def claims_per_month(layers):
    dated = layers["claims"].where(F.col("dateOfLoss").isNotNull())
    return dated.groupBy(
        F.year("dateOfLoss").alias("loss_year"), F.month("dateOfLoss").alias("loss_month")
    ).agg(F.count(F.lit(1)).alias("num_claims"))


@query(
    "events_per_year",
    "SELECT strftime(ts, '%Y') AS year, event_type, COUNT(*) AS num_events FROM events GROUP BY 1, 2",
)
def events_per_year(layers):
    """Annual frequency by year text over an event table."""
    return layers.table("events").groupBy(F.date_format("ts", "yyyy").alias("year"), "event_type").agg(
        F.count(F.lit(1)).alias("num_events")
    )


# -- whole-layer measures ----------------------------------------------------

@query(
    "layer_extent",
    "SELECT MIN(xmin) AS xmin, MIN(ymin) AS ymin, MAX(xmax) AS xmax, MAX(ymax) AS ymax FROM floodplain",
)
def layer_extent(layers):
    return extent(layers["floodplain"])


@query(
    "polygon_envelopes",
    "SELECT GFID, xmin, ymin, xmax, ymax FROM floodplain",
)
def polygon_envelopes(layers):
    return layers["floodplain"].select(
        "GFID", F.inline(F.array(g.envelope("geometry")))
    )


@query(
    "polygon_areas",
    f"SELECT GFID, {s.area('edges')} AS area, valid FROM floodplain",
)
def polygon_areas(layers):
    return measured(layers["floodplain"]).select("GFID", "area", "valid")


@query(
    "mercator_points",
    "SELECT HOSPITAL_ID, ROUND(radians(LON) * 6378137, 3) AS x,"
    " ROUND(ln(tan(pi() / 4 + radians(LAT) / 2)) * 6378137, 3) AS y FROM hospitals WHERE LON IS NOT NULL",
)
def mercator_points(layers):
    """lon/lat to Mercator metres."""
    points = layers["hospitals"].where(F.col("LON").isNotNull())
    xy = g.mercator_xy("LON", "LAT")
    return points.select("HOSPITAL_ID", F.round(xy["x"], 3).alias("x"), F.round(xy["y"], 3).alias("y"))


@query("sample_rows", "SELECT GFID, FLD_ZONE FROM floodplain ORDER BY md5(GFID), GFID LIMIT 3")
def sampled(layers):
    return sample_rows(layers["floodplain"], 3, "GFID").select("GFID", "FLD_ZONE")
