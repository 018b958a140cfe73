"""Sources and sinks: directories, schemas, binary outlines, JSON files, runs, dirty text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.scalars import number_or_null
from ..operators.scoring import level_rollup
from ..sources.layers import describe_schema, list_columns, load_layer, open_layers, row_counts, wkb_from_rings
from ..sources.records import append_run, pending, read_json_array, read_runs, runs, write_summary
from ..sources.storage import working_folder
from . import sql as s
from .records import _SCORED_SQL, _scored
from .registry import query

_TABLES = ["customer", "documents", "lineitem", "nation", "orders", "part", "region", "supplier"]


def _scratch(layers, name):
    return f"{working_folder(layers.spark)}/{name}-{uuid.uuid4().hex}"


@query("directory_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS layer, COUNT(*) AS row_count FROM {t}" for t in _TABLES))
def directory_counts(layers):
    """Every parquet file of the directory is found and opened by its name."""
    return row_counts(open_layers(layers.spark, layers.directory, _TABLES))


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz"}


@query(
    "directory_schema",
    "SELECT table_name AS layer, ordinal_position - 1 AS position, column_name, CASE data_type "
    + " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in _TYPES.items())
    + f" ELSE data_type END AS column_type FROM information_schema.columns WHERE table_name IN {tuple(_TABLES)}",
)
def directory_schema(layers):
    """Columns and types of every layer of the directory, and that the listing of columns agrees."""
    found = open_layers(layers.spark, layers.directory, _TABLES)
    listed = list_columns(found, _TABLES)
    schema = describe_schema(found, layers.spark)
    known = F.create_map(*[x for t in _TABLES for x in (F.lit(t), F.array(*map(F.lit, listed[t])))])
    return schema.where(F.element_at(known, F.col("layer"))[F.col("position")] == F.col("column_name"))


@query(
    "wkb_layer",
    f"SELECT GFID, ROUND({s.area('edges')}, 9) AS area, valid, xmin, ymax FROM floodplain",
)
def wkb_layer(layers):
    """Outlines written as binary, and read back as a layer is."""
    path = _scratch(layers, "wkb.parquet")
    rows = layers["floodplain"].select("GFID", wkb_from_rings("geometry.rings").alias("geometry"))
    rows.write.parquet(path)
    layer = load_layer(layers.spark, path, "geometry", ["GFID"])
    return layer.select(
        "GFID", F.round(g.polygon_area("geometry"), 9).alias("area"), "geometry.valid", "geometry.xmin", "geometry.ymax"
    )


@query(
    "json_array_questions",
    "SELECT o_orderpriority AS level, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS num_ids FROM orders GROUP BY o_orderpriority",
)
def json_arrays(layers):
    """Records in files that hold one JSON array each."""
    orders = layers.table("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("level"))
    # arrays of some thousands of records, each in a file of its own
    arrays = orders.groupBy(F.pmod(F.xxhash64("id"), F.lit(1 + orders.count() // 5_000))).agg(
        F.to_json(F.collect_list(F.struct("id", "level"))).alias("value")
    )
    path = _scratch(layers, "questions")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_array(layers.spark, path).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("num_ids")
    )


@query(
    "summary_sink",
    _SCORED_SQL + "SELECT coalesce(level, 'ALL') AS level, COUNT(*) AS n, ROUND(AVG(exec), 6) AS avg_exec FROM r GROUP BY ROLLUP (level)",
)
def summary(layers):
    """A summary is written, written again over itself, and read back."""
    path = _scratch(layers, "summary")
    means = level_rollup(_scored(layers))
    for _ in range(2):
        write_summary(means, path)
    back = layers.spark.read.json(path, schema="level string, n long, avg_exec double")
    return back.select("level", "n", F.round("avg_exec", 6).alias("avg_exec"))


@query(
    "runs_once",
    "SELECT 'run-' || CAST(o_orderkey % 3 AS VARCHAR) AS run_id, COUNT(*) AS num_records, COUNT(DISTINCT o_orderkey) AS num_ids,"
    " 0 AS num_pending FROM orders GROUP BY 1",
)
def runs_once(layers):
    """Three runs are appended, each of them twice; every record is there once, and nothing is left to do."""
    orders = layers.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("question"))
    path = _scratch(layers, "runs")
    for i in [0, 1, 2, 1, 0, 2]:
        append_run(orders.where(F.col("id") % 3 == i).withColumn("id", F.col("id").cast("string")), path, f"run-{i}")
    records = read_runs(layers.spark, path)
    left = pending(orders.withColumn("id", F.col("id").cast("string")), records).agg(F.count("*").cast("int").alias("num_pending"))
    counted = records.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("num_ids"))
    entered = runs(layers.spark, path).select("run_id", "num_records")
    whole = counted.join(entered, "run_id").where("n = num_records")
    return whole.select("run_id", "num_records", "num_ids", left.scalar().alias("num_pending"))


_DIRTY = (
    "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_totalprice AS {t}) WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || CAST(o_custkey AS {t}) ELSE '' END"
)


@query(
    "dirty_amounts",
    f"SELECT o_orderpriority, COUNT(*) AS n, COUNT(amount) AS num_numbers, ROUND(SUM(amount), 2) AS total FROM ("
    f"SELECT o_orderpriority, TRY_CAST({_DIRTY.format(t='VARCHAR')} AS DOUBLE) AS amount FROM orders) GROUP BY o_orderpriority",
)
def dirty_amounts(layers):
    """Amounts as text; what is no number counts as missing."""
    text = layers.table("orders").select("o_orderpriority", F.expr(_DIRTY.format(t="STRING")).alias("amount"))
    return text.select("o_orderpriority", number_or_null("amount").alias("amount")).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count("amount").alias("num_numbers"), F.round(F.sum("amount"), 2).alias("total")
    )

