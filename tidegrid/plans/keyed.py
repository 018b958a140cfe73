"""Questions over layers joined by key: tract, county prefix, state, ZIP."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import county_key, has_prefix, year_text
from ..operators.aggregates import top_n, weighted_mean
from ..operators.key_join import JOIN_RULES, _layer_of, join_layers, join_rules
from ..sources.layers import row_counts
from ..sources.records import pending
from .layers import LAYER_NAMES
from .registry import query


def row_count():
    return F.count(F.lit(1))


# -- one query per key rule of the catalog ------------------------------------

# claims (many per tract) against the tract layers, tract layers against each
# other and against counties; the ZIP rule has its own query below, which counts
# pairs without writing them out


def _key_rule(kind, left, right):
    a, b = _layer_of(left), _layer_of(right)
    condition = f"{left.replace(a + '.', 'a.')} = {right.replace(b + '.', 'b.')}"

    @query(
        f"key_rule_{a}_{b}",
        f"SELECT b.GEOID AS key, COUNT(*) AS num_rows FROM {a} a JOIN {b} b ON {condition} GROUP BY b.GEOID",
    )
    def run(layers):
        right_rows = layers[b].select("GEOID", F.col("GEOID").alias("key"))
        return join_layers(layers[a], a, right_rows, b).groupBy("key").agg(row_count().alias("num_rows"))


for _kind in ("direct", "concat"):
    for _left, _right in JOIN_RULES[_kind]:
        if "ZIP" not in _left:
            _key_rule(_kind, _left, _right)


@query(
    "zip_join",
    "SELECT h.ZIP, COUNT(*) AS num_pairs FROM hospitals h JOIN schools s ON h.ZIP = s.ZIP GROUP BY h.ZIP",
)
def zip_join(layers):
    """Hospital-school pairs per ZIP: both sides are counted first, so a crowded
    ZIP costs two counters, not all its pairs."""
    hospitals = layers["hospitals"].groupBy("ZIP").agg(row_count().alias("n_hospitals"))
    schools = layers["schools"].groupBy("ZIP").agg(row_count().alias("n_schools"))
    return hospitals.join(schools, "ZIP").select(
        "ZIP", (F.col("n_hospitals") * F.col("n_schools")).alias("num_pairs")
    )


# -- two layers ----------------------------------------------------------------

@query(
    "prefix_join_topn",
    # the mean of each county on its own, then ranked
    "SELECT county_name FROM (SELECT NAME AS county_name, row_number() OVER (ORDER BY m DESC, NAME) AS place FROM ("
    "SELECT NAME, (SELECT SUM(PRED0_PE) / COUNT(PRED0_PE) FROM cre WHERE substr(cre.GEOID, 1, 5) = county.GEOID) AS m"
    " FROM county WHERE STATEFP = '48') WHERE m IS NOT NULL) WHERE place <= 3",
)
def prefix_join_topn(layers):
    counties = layers["county"].where(F.col("STATEFP") == "48").select(
        F.col("GEOID").alias("county_geoid"), F.col("NAME").alias("county_name")
    )
    rows = layers["cre"].where(F.col("PRED0_PE").isNotNull() & has_prefix("GEOID", "48")).select(
        county_key().alias("county_geoid"), "PRED0_PE"
    )
    return top_n(rows.join(counties, "county_geoid"), ["county_name"], F.avg("PRED0_PE"), 3)


@query(
    "top_year",
    # claims whose county exists in the state, counted per year, then ranked
    "WITH hit AS (SELECT year(dateOfLoss) AS y FROM claims WHERE dateOfLoss IS NOT NULL AND EXISTS ("
    "SELECT 1 FROM county WHERE STATEFP = '22' AND substr(claims.GEOID, 1, 5) = county.GEOID)),"
    " n AS (SELECT y, COUNT(*) AS n FROM hit GROUP BY y)"
    " SELECT CAST(y AS VARCHAR) AS year FROM (SELECT y, row_number() OVER (ORDER BY n DESC, y) AS place FROM n) WHERE place = 1",
)
def top_year(layers):
    counties = layers["county"].where(F.col("STATEFP") == "22").select(
        F.col("GEOID").alias("county_geoid")
    )
    # counted per county and year before the join
    counts = (
        layers["claims"].where(F.col("dateOfLoss").isNotNull() & has_prefix("GEOID", "22"))
        .groupBy(county_key().alias("county_geoid"), year_text("dateOfLoss").alias("year"))
        .agg(row_count().alias("n"))
    )
    return top_n(counts.join(counties, "county_geoid"), ["year"], F.sum("n"), 1)


@query(
    "state_join_fanout",
    "SELECT c.NAME AS county_name, COUNT(*) AS num_rows, COUNT(DISTINCT s.SCHOOL_ID) AS num_schools"
    " FROM schools s JOIN county c ON s.STATEFP = c.STATEFP WHERE c.STATEFP = '22' GROUP BY c.NAME",
)
def state_join_fanout(layers):
    """Every county of a state meets every school of it; schools are counted per
    state first."""
    schools = layers["schools"].where(F.col("STATEFP") == "22").groupBy("STATEFP").agg(
        row_count().alias("num_rows"), F.count_distinct("SCHOOL_ID").alias("num_schools")
    )
    counties = layers["county"].where(F.col("STATEFP") == "22").groupBy("STATEFP", "NAME").agg(
        row_count().alias("n")
    )
    return counties.join(schools, "STATEFP").select(
        F.col("NAME").alias("county_name"),
        (F.col("num_rows") * F.col("n")).alias("num_rows"), "num_schools",
    )


# -- three layers --------------------------------------------------------------

def _claim_tracts(layers, state):
    """Distinct tracts with claims in a state."""
    return layers["claims"].where(F.col("STATEFP") == state).select("GEOID").distinct()


@query(
    "three_key_distinct",
    # tracts of the indicator table that the two others have as well
    "SELECT COUNT(*) AS num_tracts FROM (SELECT GEOID FROM svi WHERE RPL_THEMES > 0.4"
    " INTERSECT SELECT GEOID FROM cre WHERE POPUNI > 1000"
    " INTERSECT SELECT GEOID FROM claims WHERE STATEFP = '22')",
)
def three_key_distinct(layers):
    svi = layers["svi"].where(F.col("RPL_THEMES") > 0.4).select("GEOID")
    cre = layers["cre"].where(F.col("POPUNI") > 1000).select("GEOID")
    joined = _claim_tracts(layers, "22").join(svi, "GEOID").join(cre, "GEOID")
    return joined.agg(F.count_distinct("GEOID").alias("num_tracts"))


@query(
    "weighted_mean_topn",
    "WITH v AS (SELECT nri.GEOID, RFLD_EALT + RFLD_AFREQ AS x, POPUNI AS w FROM nri, cre"
    " WHERE nri.GEOID = cre.GEOID AND POPUNI > 0 AND EXISTS ("
    "SELECT 1 FROM claims WHERE STATEFP = '12' AND claims.GEOID = nri.GEOID)),"
    " m AS (SELECT DISTINCT GEOID, SUM(x * w) OVER t / SUM(w) OVER t AS m FROM v WHERE x IS NOT NULL"
    " WINDOW t AS (PARTITION BY GEOID))"
    " SELECT GEOID FROM (SELECT GEOID, row_number() OVER (ORDER BY m DESC, GEOID) AS place FROM m) WHERE place <= 5",
)
def weighted_mean_topn(layers):
    nri = layers["nri"].where(F.col("RFLD_EALT").isNotNull() & F.col("RFLD_AFREQ").isNotNull())
    cre = layers["cre"].where(F.col("POPUNI") > 0).select("GEOID", "POPUNI")
    joined = _claim_tracts(layers, "12").join(nri, "GEOID").join(cre, "GEOID")
    means = weighted_mean(
        joined, ["GEOID"], F.col("RFLD_EALT") + F.col("RFLD_AFREQ"), F.col("POPUNI").cast("double")
    )
    return means.orderBy(F.desc("weighted_mean"), "GEOID").limit(5).select("GEOID")


@query(
    "weighted_mean_by_county",
    "SELECT LEFT(n.GEOID, 5) AS county_geoid, ROUND(SUM(n.RFLD_RISKS * r.POPUNI) / SUM(r.POPUNI), 6) AS mean_risk"
    " FROM nri n JOIN cre r ON n.GEOID = r.GEOID WHERE r.POPUNI > 0 GROUP BY 1",
)
def weighted_mean_by_county(layers):
    joined = layers["nri"].join(layers["cre"].where(F.col("POPUNI") > 0), "GEOID").withColumn(
        "county_geoid", county_key()
    )
    means = weighted_mean(
        joined, ["county_geoid"], F.col("RFLD_RISKS"), F.col("POPUNI").cast("double"), "mean_risk"
    )
    return means.withColumn("mean_risk", F.round("mean_risk", 6))


# -- semi and anti joins -------------------------------------------------------

@query(
    "semi_key",
    "SELECT COUNT(*) AS num_tracts FROM census_tracts t WHERE t.GEOID LIKE '22%'"
    " AND EXISTS (SELECT 1 FROM claims cl WHERE cl.GEOID = t.GEOID AND cl.dateOfLoss < DATE '1995-06-01')",
)
def semi_key(layers):
    early = layers["claims"].where("dateOfLoss < DATE'1995-06-01'")
    tracts = layers["census_tracts"].where(has_prefix("GEOID", "22"))
    return tracts.join(early, "GEOID", "left_semi").agg(row_count().alias("num_tracts"))


@query(
    "in_semi",
    "SELECT ROUND(AVG(RFLD_RISKS), 6) AS avg_risk FROM nri WHERE GEOID IN"
    " (SELECT GEOID FROM claims WHERE CAST(amountPaidOnBuildingClaim AS DOUBLE) > 90000)",
)
def in_semi(layers):
    large = layers["claims"].where(F.col("amountPaidOnBuildingClaim").cast("double") > 90000)
    return layers["nri"].join(large, "GEOID", "left_semi").agg(
        F.round(F.avg("RFLD_RISKS"), 6).alias("avg_risk")
    )


@query(
    "resume_anti_join",
    "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def resume_anti_join(layers):
    """Records without a result yet: documents no label exists for."""
    todo = layers.table("documents").select("doc_id")
    return pending(todo, layers.table("labels"), "doc_id")


_RULE_ROWS = ", ".join(
    f"('{kind}', '{_layer_of(left)}')" for kind, pairs in JOIN_RULES.items() for left, _ in pairs
)


@query(
    "join_rule_lookup",
    "WITH counts AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS layer, COUNT(*) AS n FROM {n}" for n in LAYER_NAMES)
    + f") SELECT r.kind, COUNT(*) AS num_rules, CAST(SUM(c.n) AS BIGINT) AS left_rows FROM (VALUES {_RULE_ROWS})"
    " r(kind, layer) JOIN counts c ON r.layer = c.layer GROUP BY r.kind",
)
def join_rule_lookup(layers):
    """The rule catalog joined to the layers: rules and rows of their left layers by kind."""
    left = F.regexp_extract("left_expr", r"(\w+)\.", 1).alias("layer")
    rules = join_rules(layers.spark).select("kind", left)
    return rules.join(row_counts(layers), "layer").groupBy("kind").agg(
        row_count().alias("num_rules"), F.sum("row_count").alias("left_rows")
    )
