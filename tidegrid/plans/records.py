"""Retrieval, similarity, result comparison, reports and profiles.

Pairs of documents (one and the next) stand for gold and predicted texts, the
embeddings for questions and described columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null, flatten_text, iso_text, strip_fences
from ..functions.similarity import (
    COMPONENT_WEIGHTS, WHITE_SPACE, cosine, jaccard, set_difference, text_jaccard, tokens, weighted_score,
)
from ..operators.comparison import frames_match, multiset_jaccard, top_shared_items
from ..operators.profile import INDEXED, profile_layers
from ..operators.retrieval import corpus_texts, cosine_topk, cosine_topk_pruned, level_k
from ..operators.scoring import first_examples, level_rollup, missing_counts, status_share
from ..sources.layers import row_counts
from ..sources.records import append_json_lines, read_json_lines
from ..sources.storage import working_folder
from .layers import LAYER_NAMES
from .registry import query

# -- retrieval -----------------------------------------------------------------

_SCORES = (
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),"
    " scored AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS query_label, i.label AS item_label,"
    " ROUND(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))"
    " + 1e-10), 6) AS score FROM e q, e i)"
)


def _questions(layers):
    return layers.table("embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"),
        F.col("label").alias("query_label"),
    )


def _items(layers):
    return layers.table("embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vector"),
        F.col("label").alias("item_label"), (F.col("vec_id") % 97 == 0).alias("critical"),
    )


_TOPK = (
    _SCORES + " SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored)"
    " WHERE rank <= CASE WHEN query_label = 0 THEN 3 WHEN query_label IN (1, 2) THEN 4 ELSE 5 END"
)


@query("cosine_topk", _TOPK)
def topk(layers):
    """As many items per question as its level asks for."""
    level = F.concat(F.lit("L"), F.col("query_label").cast("string"))
    return cosine_topk(_questions(layers).withColumn("k", level_k(level)), _items(layers), "k")


@query("cosine_topk_pruned", _TOPK)
def topk_pruned(layers):
    """The same over blocks around pivots, of which a query visits those that can matter."""
    level = F.concat(F.lit("L"), F.col("query_label").cast("string"))
    return cosine_topk_pruned(_questions(layers).withColumn("k", level_k(level)), _items(layers), "k")


@query(
    "cosine_topk_forced",
    _SCORES + " SELECT query_id, item_id, item_label, score, CASE WHEN rank <= 10 THEN rank END AS rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY query_id, item_label ORDER BY score DESC, item_id) AS rank FROM scored"
    " WHERE query_label = item_label) WHERE rank <= 10 OR item_id % 97 = 0",
)
def topk_forced(layers):
    """Ten best of the question's own group, and every critical item of it."""
    return cosine_topk(
        _questions(layers), _items(layers), 10,
        within=[("query_label", "item_label")], forced="critical",
    )


# -- text and set similarity -----------------------------------------------------

def _pairs(layers):
    """Each document beside the next one.

    Texts are spread by pair before anything is done with them, so the work on
    long texts does not depend on how the input is cut; the join reuses that
    partitioning.
    """
    docs = layers.table("documents")
    gold = docs.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("gold"))
    predicted = docs.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("predicted"))
    return gold.repartition("pair_id").join(predicted.repartition("pair_id"), "pair_id")


def _set_pairs(layers):
    """Distinct tokens of both texts; component sets are taken from these."""
    pairs = _token_pairs(layers)
    return pairs.select(
        "pair_id", F.array_distinct("gold").alias("gold"), F.array_distinct("predicted").alias("predicted")
    )


def _token_pairs(layers):
    return _pairs(layers).select(
        "pair_id", tokens(F.col("gold")).alias("gold"), tokens(F.col("predicted")).alias("predicted")
    )


_DUCK_SPACE = WHITE_SPACE.replace("\\x0B", "\\x{0B}").replace("\\x1C-\\x1F", "\\x{1C}-\\x{1F}")
_PAIRS = (
    "WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), "
    f"'{_DUCK_SPACE}'), lambda x: x <> '') AS items FROM documents),"
    " pairs AS (SELECT g.doc_id AS pair_id, g.text AS gold_text, p.text AS predicted_text,"
    " g.items AS gold, p.items AS predicted FROM t g JOIN t p ON p.doc_id = g.doc_id + 1)"
)


def _jaccard_sql(a, b):
    shared = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    union = f"(len(list_distinct({a})) + len(list_distinct({b})) - {shared})"
    return f"CASE WHEN {union} = 0 THEN 1 ELSE CAST({shared} AS DOUBLE) / {union} END"


@query(
    "token_jaccard",
    _PAIRS + " SELECT pair_id, ROUND(CASE WHEN len(gold_text) > 0 AND len(predicted_text) > 0 THEN "
    + _jaccard_sql("gold", "predicted") + " ELSE 0 END, 6) AS score FROM pairs",
)
def token_jaccard(layers):
    score = text_jaccard(F.col("gold"), F.col("predicted"))
    return _pairs(layers).select("pair_id", F.round(score, 6).alias("score"))


# The eight components of a pair are its words by length.
_LENGTHS = {
    "spatial_functions": (1, 2),
    "select": (3, 3),
    "where": (4, 4),
    "from": (5, 5),
    "join": (6, 6),
    "predicate": (7, 7),
    "group_by": (8, 9),
    "order_by": (10, None),
}


def _component(column, name):
    low, high = _LENGTHS[name]
    if high is None:
        return F.filter(column, lambda t: F.length(t) >= low)
    return F.filter(column, lambda t: F.length(t).between(low, high))


def _component_sql(column, name):
    low, high = _LENGTHS[name]
    fits = f">= {low}" if high is None else f"BETWEEN {low} AND {high}"
    return f"list_filter({column}, lambda x: length(x) {fits})"


@query(
    "weighted_component_score",
    _PAIRS + " SELECT pair_id, ROUND("
    + " + ".join(
        f"({_jaccard_sql(_component_sql('gold', n), _component_sql('predicted', n))}) * CAST({w} AS DOUBLE)"
        for n, w in COMPONENT_WEIGHTS.items()
    )
    + ", 6) AS score FROM pairs",
)
def weighted_component_score(layers):
    rows = _set_pairs(layers)
    for name in COMPONENT_WEIGHTS:
        rows = rows.withColumns(
            {f"g_{name}": _component("gold", name), f"p_{name}": _component("predicted", name)}
        )
    parts = {n: (F.col(f"g_{n}"), F.col(f"p_{n}")) for n in COMPONENT_WEIGHTS}
    return rows.select("pair_id", F.round(weighted_score(parts), 6).alias("score"))


def _except_sql(a, b):
    return f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))"


@query(
    "missing_extra_sets",
    _PAIRS + " SELECT pair_id, CAST(len(list_intersect(list_distinct(gold), list_distinct(predicted))) AS BIGINT) AS n_matches,"
    f" CAST(len({_except_sql('gold', 'predicted')}) AS BIGINT) AS n_missing,"
    f" CAST(len({_except_sql('predicted', 'gold')}) AS BIGINT) AS n_extra,"
    f" list_min({_except_sql('gold', 'predicted')}) AS first_missing FROM pairs",
)
def missing_extra_sets(layers):
    parts = _set_pairs(layers).select(
        "pair_id", set_difference(F.col("gold"), F.col("predicted")).alias("d")
    )
    return parts.select(
        "pair_id",
        F.size("d.matches").cast("long").alias("n_matches"),
        F.size("d.missing").cast("long").alias("n_missing"),
        F.size("d.extra").cast("long").alias("n_extra"),
        F.array_min("d.missing").alias("first_missing"),
    )


def _missing_count_sql(name):
    missing = _except_sql(_component_sql("gold", name), _component_sql("predicted", name))
    return f"CAST(SUM(CASE WHEN len({missing}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_{name}"


@query(
    "missing_component_counts",
    _PAIRS + " SELECT " + ", ".join(_missing_count_sql(n) for n in ("from", "where", "join")) + " FROM pairs",
)
def missing_component_counts(layers):
    """Pairs that lack an item of a component, for the three reported components."""
    rows, names = _set_pairs(layers), ("from", "where", "join")
    lacking = rows.select(
        *[
            F.array_except(_component("gold", n), _component("predicted", n)).alias(f"missing_{n}")
            for n in names
        ]
    )
    return missing_counts(lacking, [f"missing_{n}" for n in names])


_ITEM_COUNTS = (
    ", c AS (SELECT pair_id, item, SUM(l) AS n_left, SUM(r) AS n_right FROM ("
    "SELECT pair_id, unnest(gold) AS item, 1 AS l, 0 AS r FROM pairs UNION ALL"
    " SELECT pair_id, unnest(predicted) AS item, 0 AS l, 1 AS r FROM pairs) GROUP BY pair_id, item)"
)


@query(
    "multiset_jaccard",
    _PAIRS + _ITEM_COUNTS
    + ", m AS (SELECT pair_id, CAST(SUM(least(n_left, n_right)) AS BIGINT) AS shared FROM c GROUP BY pair_id)"
    " SELECT pair_id, CAST(len(gold) AS BIGINT) AS size_left, CAST(len(predicted) AS BIGINT) AS size_right,"
    " coalesce(shared, 0) AS matches, ROUND(CASE WHEN len(gold) + len(predicted) = 0 THEN 1 ELSE"
    " CAST(coalesce(shared, 0) AS DOUBLE) / greatest(len(gold) + len(predicted) - coalesce(shared, 0), 1) END, 6) AS score"
    " FROM pairs LEFT JOIN m USING (pair_id)",
)
def multiset(layers):
    scores = multiset_jaccard(_token_pairs(layers), "pair_id", "gold", "predicted")
    return scores.withColumn("score", F.round("score", 6))


@query(
    "top_shared_items",
    _PAIRS + _ITEM_COUNTS
    + " SELECT pair_id, item, CAST(least(n_left, n_right) AS BIGINT) AS matches, rank FROM (SELECT *, row_number() OVER"
    " (PARTITION BY pair_id ORDER BY length(item) DESC, item) AS rank FROM c WHERE least(n_left, n_right) > 0)"
    " WHERE rank <= 5",
)
def shared_items(layers):
    return top_shared_items(_token_pairs(layers), "pair_id", "gold", "predicted")


# -- result comparison -------------------------------------------------------------

_TOTALS = (
    "SELECT l_suppkey, l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem"
    " GROUP BY l_suppkey, l_returnflag"
)


def _totals(layers):
    return layers.table("lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


def _match_sql(other):
    order = "ORDER BY l_suppkey, l_returnflag, total"
    return (
        f"WITH a AS (SELECT *, row_number() OVER ({order}) AS place FROM ({_TOTALS})),"
        f" b AS (SELECT *, row_number() OVER ({order}) AS place FROM (SELECT {other}))"
        " SELECT rows_differing = 0 AS equal, rows_a, rows_b, rows_differing FROM ("
        "SELECT COUNT(a.place) AS rows_a, COUNT(b.place) AS rows_b, CAST(SUM(CASE WHEN a.place IS NOT NULL"
        " AND b.place IS NOT NULL AND a.l_returnflag = b.l_returnflag"
        " AND abs(a.l_suppkey - b.l_suppkey) <= 0.001 + 0.00001 * abs(b.l_suppkey)"
        " AND abs(a.total - b.total) <= 0.001 + 0.00001 * abs(b.total) THEN 0 ELSE 1 END) AS BIGINT) AS rows_differing"
        " FROM a FULL JOIN b ON a.place = b.place)"
    )


@query("frames_match", _match_sql(f"l_suppkey, l_returnflag, total + 0.0001 AS total FROM ({_TOTALS})"))
def frames_equal(layers):
    """Other names, other row order, other number type and a little noise: equal."""
    a = _totals(layers)
    b = a.orderBy(F.desc("total")).select(
        F.col("l_suppkey").cast("double").alias("supplier"),
        F.col("l_returnflag").alias("flag"),
        (F.col("total") + 0.0001).alias("amount"),
    )
    return frames_match(a, b)


@query("frames_match_noise", _match_sql(f"l_suppkey, l_returnflag, total * 1.001 AS total FROM ({_TOTALS})"))
def frames_noise(layers):
    """Noise above the tolerance."""
    a = _totals(layers)
    return frames_match(a, a.withColumn("total", F.col("total") * 1.001))


@query("frames_match_fewer", _match_sql(f"* FROM ({_TOTALS}) WHERE NOT (l_suppkey = 7 AND l_returnflag = 'A')"))
def frames_fewer(layers):
    """A row is missing, so every later row compares with its neighbour."""
    a = _totals(layers)
    missing = (F.col("l_suppkey") == 7) & (F.col("l_returnflag") == "A")
    return frames_match(a, a.where(~missing))


# -- reports -----------------------------------------------------------------------

_SCORED_SQL = (
    "WITH r AS (SELECT d.doc_id AS id, d.lang AS level, l.quality = 1 AS exec_ok,"
    " CAST(l.quality AS DOUBLE) AS exec, CAST(l.toxic AS DOUBLE) AS metric,"
    " CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1000) AS text,"
    " CASE WHEN l.toxic = 1 THEN 'error' WHEN l.quality = 1 THEN 'correct' ELSE 'wrong' END AS status"
    " FROM documents d JOIN labels l ON d.doc_id = l.doc_id) "
)


def _scored(layers):
    docs = layers.table("documents").select("doc_id", "lang", "n_chars")
    joined = docs.join(layers.table("labels"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("level"),
        (F.col("quality") == 1).alias("exec_ok"),
        F.col("quality").cast("double").alias("exec"), F.col("toxic").cast("double").alias("metric"),
        (F.col("n_chars").cast("double") / (F.col("n_chars") + 1000)).alias("text"),
        F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "correct").otherwise("wrong").alias("status"),
    )


@query(
    "level_rollup",
    _SCORED_SQL + "SELECT coalesce(level, 'ALL') AS level, COUNT(*) AS n, ROUND(AVG(exec), 6) AS avg_exec,"
    " ROUND(AVG(metric), 6) AS avg_metric, ROUND(AVG(text), 6) AS avg_text FROM r GROUP BY ROLLUP (level)",
)
def rollup(layers):
    means = level_rollup(_scored(layers))
    return means.select(
        "level", "n", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("exec", "metric", "text")]
    )


@query(
    "status_share",
    _SCORED_SQL + "SELECT status, COUNT(*) AS n, ROUND(COUNT(*) * CAST(100 AS DOUBLE) /"
    " (SELECT COUNT(*) FROM r), 6) AS percent FROM r GROUP BY status",
)
def shares(layers):
    return status_share(_scored(layers)).withColumn("percent", F.round("percent", 6))


@query(
    "first_examples_per_level",
    _SCORED_SQL + ", firsts AS (SELECT MIN(id) AS id, level, exec_ok, 0 AS filler FROM r GROUP BY level, exec_ok),"
    " fill AS (SELECT id, level, exec_ok, 1 AS filler FROM r WHERE id NOT IN (SELECT id FROM firsts)"
    " ORDER BY id LIMIT 12), picked AS (SELECT * FROM firsts UNION ALL SELECT * FROM fill)"
    " SELECT id, level, exec_ok, filler FROM picked ORDER BY filler,"
    " CASE WHEN filler = 0 THEN level END, CASE WHEN filler = 0 THEN NOT exec_ok END, id LIMIT 12",
)
def examples(layers):
    return first_examples(_scored(layers))


# -- values and profiles --------------------------------------------------------------

@query(
    "normalised_values",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    " || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS ts,"
    " CASE WHEN isfinite(value) THEN value END AS value FROM events",
)
def normalised(layers):
    return layers.table("events").select(
        "event_id", iso_text("ts").alias("ts"), finite_or_null("value").alias("value")
    )


@query(
    "flatten_text",
    "SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(text, '```(sql)?', '', 'g')), "
    f"'{_DUCK_SPACE}', ' ', 'g')) AS text FROM conversations",
)
def flattened(layers):
    """Texts without code fences and with single blanks."""
    text = flatten_text(strip_fences(F.col("text")))
    return layers.table("conversations").select("conv_id", "turn", text.alias("text"))


@query(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS layer, COUNT(*) AS row_count FROM {n}" for n in LAYER_NAMES),
)
def counts(layers):
    return row_counts(layers)


@query(
    "cosine_column",
    "SELECT a.vec_id, ROUND(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v))"
    " * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 6) AS score"
    " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a"
    " JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON b.vec_id = a.vec_id + 1",
)
def cosine_column(layers):
    """Cosine of two vector columns of a row: each vector and the next one."""
    rows = layers.table("embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    score = F.round(cosine(F.col("embedding"), F.col("next")), 6)
    return rows.join(after, "vec_id").select("vec_id", score.alias("score"))


@query(
    "corpus_text",
    "SELECT CAST(o_custkey AS VARCHAR) AS table_name, CAST(o_custkey AS VARCHAR) || chr(10) || string_agg("
    "o_orderpriority || ': ' || coalesce(o_orderstatus, ''), chr(10) ORDER BY o_orderkey) AS text"
    " FROM orders GROUP BY o_custkey",
)
def corpus_text(layers):
    """One text per customer's orders, put together like that of a table and its columns."""
    columns = layers.table("orders").select(
        F.col("o_custkey").cast("string").alias("table_name"), F.col("o_orderkey").alias("position"),
        F.col("o_orderpriority").alias("column_name"), F.col("o_orderstatus").alias("description"),
    )
    return corpus_texts(columns)


@query(
    "json_lines_round_trip",
    "SELECT o_orderpriority AS question, COUNT(*) AS num_records,"
    " COUNT(DISTINCT o_orderkey) AS num_ids FROM orders GROUP BY o_orderpriority",
)
def json_lines_round_trip(layers):
    """Records appended as JSON lines in two runs, then read back by the tolerant reader."""
    orders = layers.table("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("question"),
        F.array("o_orderpriority").alias("chosen_tables"),
    )
    path = f"{working_folder(layers.spark)}/records-{uuid.uuid4().hex}"
    late = F.col("id").cast("long") % 3 == 0
    append_json_lines(orders.where(~late), path)
    append_json_lines(orders.where(late), path)
    return read_json_lines(layers.spark, path).groupBy("question").agg(
        F.count(F.lit(1)).alias("num_records"), F.count_distinct("id").alias("num_ids")
    )


_AREA = ["GEOID", "STATEFP", "COUNTYFP", "NAME", "geometry"]
_CLAIM = ["id", "GEOID", "STATEFP", "dateOfLoss", "amountPaidOnBuildingClaim", "amountPaidOnContentsClaim",
          "amountPaidOnIncreasedCostOfComplianceClaim"]
_PROFILE = {
    "county": ("GEOID", _AREA),
    "census_tracts": ("GEOID", _AREA),
    "zcta": ("GEOID", ["GEOID", "STATEFP", "geometry"]),
    "floodplain": ("GFID", ["GFID", "FLD_ZONE", "STATEFP", "geometry"]),
    "claims": (_CLAIM, _CLAIM),
    "nri": ("GEOID", ["GEOID", "CFLD_RISKS", "CFLD_EALP", "RFLD_RISKS", "RFLD_RISKV", "RFLD_RISKR", "RFLD_EVNTS",
                      "RFLD_AFREQ", "RFLD_EXP_AREA", "RFLD_EALB", "RFLD_EALT"]),
    "svi": ("GEOID", ["GEOID", "FIPS", "E_TOTPOP", "E_HH", "EP_NOINT", "EP_POV150", "EP_LIMENG", "EP_MINRTY",
                      "EP_UNEMP", "RPL_THEME1", "RPL_THEME4", "RPL_THEMES", "SPL_THEME1", "SPL_THEMES"]),
    "cre": ("GEOID", ["GEOID", "POPUNI", "WATER_TRACT", "PRED12_E", "PRED0_PE", "PRED12_PE", "PRED3_PE"]),
    "hospitals": ("HOSPITAL_ID", ["HOSPITAL_ID", "NAME", "CITY", "ZIP", "COUNTYFIPS", "STATEFP", "TYPE", "LON", "LAT", "UNIQUE_ID"]),
    "schools": ("SCHOOL_ID", ["SCHOOL_ID", "NAME", "CITY", "ZIP", "STATEFP", "TYPE", "LON", "LAT", "UNIQUE_ID"]),
}
_DESCRIPTIONS = {"svi": {"E_TOTPOP": "population estimate"}, "county": {"geometry": "outline"}}


def _profile_sql():
    """Samples are shown in row order, NULLs as a word, so that rows can be told apart."""
    parts = []
    for layer, (key, columns) in _PROFILE.items():
        for i, c in enumerate(columns):
            text = _DESCRIPTIONS.get(layer, {}).get(c, "unknown")
            row = f"CAST({key} AS VARCHAR)" if isinstance(key, str) else (
                "concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'NULL')" for k in key) + ")"
            )
            sample = (
                "CAST(NULL AS VARCHAR)" if c == "geometry" else
                f"(SELECT string_agg(coalesce(v, 'NULL'), '|' ORDER BY md5(k), k) FROM (SELECT CAST({c} AS VARCHAR) AS v,"
                f" {row} AS k FROM {layer} ORDER BY md5({row}), {row} LIMIT 3))"
            )
            parts.append(
                f"SELECT '{layer}' AS layer, {i} AS position, '{c}' AS column_name, '{text}' AS description,"
                f" {'true' if c in INDEXED else 'false'} AS indexed,"
                f" {'true' if c == 'geometry' else 'false'} AS avoid_select_star,"
                f" (SELECT COUNT(*) FROM {layer}) AS row_count, {sample} AS sample"
            )
    return " UNION ALL ".join(parts)


@query("profile_layers", _profile_sql())
def profiles(layers):
    """Profile of every layer with whole sample rows; outlines are not shown as text.

    Claims have no unique key, so their sample is drawn by all their columns.
    """
    profile = profile_layers(layers, {n: key for n, (key, _) in _PROFILE.items()}, _DESCRIPTIONS)
    shown = F.transform("sample", lambda v: F.coalesce(v, F.lit("NULL")))
    return profile.select(
        "layer", "position", "column_name", "description", "indexed", "avoid_select_star", "row_count",
        F.when(F.col("column_name") != "geometry", F.array_join(shown, "|")).alias("sample"),
    )


@query(
    "set_jaccard_by_source",
    "WITH w AS (SELECT source, list_distinct(flatten(list(string_split_regex(lang, 'e')))) AS letters FROM documents GROUP BY source)"
    " SELECT a.source, ROUND(" + _jaccard_sql("a.letters", "['', 'n', 's', 'd', 'fr']") + ", 6) AS score FROM w a",
)
def set_jaccard(layers):
    """Plain set Jaccard of array columns: parts of the language codes of a source."""
    parts = layers.table("documents").select("source", F.explode(F.split("lang", "e")).alias("part"))
    sets = parts.distinct().groupBy("source").agg(F.collect_set("part").alias("letters"))
    known = F.array(*[F.lit(v) for v in ("", "n", "s", "d", "fr")])
    return sets.select("source", F.round(jaccard(F.col("letters"), known), 6).alias("score"))
