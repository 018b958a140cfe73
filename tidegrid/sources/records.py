"""Question, prediction and result records as JSON."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("output_type", T.StringType()),
        T.StructField("expected_columns", T.ArrayType(T.StringType())),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("gt_sql", T.StringType()),
        T.StructField("generated_sql", T.StringType()),
        T.StructField("chosen_tables", T.ArrayType(T.StringType())),
        T.StructField("chosen_columns", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = QUESTION_SCHEMA) -> DataFrame:
    """A file holding one JSON array of records."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame:
    """One record per line; lines that do not parse are skipped."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# A store of runs has a folder for the records of each run, and a manifest with a line for each run that ended.
_RUNS, _MANIFEST = "runs", "manifest"
_RUN = "run_id string, ended timestamp, num_records bigint"


def append_run(df: DataFrame, path: str, run_id: str) -> bool:
    """Append the records of one run to a store, so that a repeated call adds nothing.

    The records go to a folder of the run, over what a failed call may have left
    there; only then is the run entered in the manifest, and readers see none but
    entered runs.  A run that is entered already is left as it is: False.
    """
    if not re.fullmatch(r"[\w.-]+", run_id) or run_id.startswith((".", "_")):
        raise ValueError(f"a run id is a plain file name, not {run_id!r}")
    spark = df.sparkSession
    if not runs(spark, path).where(F.col("run_id") == run_id).isEmpty():
        return False
    folder = f"{path}/{_RUNS}/{run_id}"
    df.write.mode("overwrite").json(folder)
    count = spark.read.text(folder).agg(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("ended"), F.count("*").alias("num_records"))
    count.coalesce(1).write.mode("append").json(f"{path}/{_MANIFEST}")
    return True


def runs(spark: SparkSession, path: str) -> DataFrame:
    """run_id, ended, num_records of every run that ended."""
    if not _exists(spark, f"{path}/{_MANIFEST}"):
        return spark.createDataFrame([], _RUN)
    return spark.read.json(f"{path}/{_MANIFEST}", schema=_RUN).dropDuplicates(["run_id"])


def read_runs(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame:
    """The records of all runs that ended, with their run_id; lines that do not parse are skipped."""
    ended = [r["run_id"] for r in runs(spark, path).select("run_id").collect()]
    if not ended:
        return spark.createDataFrame([], schema).withColumn("run_id", F.lit(None).cast("string"))
    rows = read_json_lines(spark, [f"{path}/{_RUNS}/{r}" for r in sorted(ended)], schema)
    return rows.withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pending(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Records whose key has no result yet."""
    return todo.join(done.select(key), key, "left_anti")
