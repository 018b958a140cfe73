"""Rollups over scored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how many example pairs a report shows.
EXAMPLES = 12


def level_rollup(
    df: DataFrame, scores: Sequence[str] = ("exec", "metric", "text"), level: str = "level"
) -> DataFrame:
    """Count and mean scores per level, and over all rows (level 'ALL')."""
    return (
        df.rollup(level)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.grouping(level).alias("__all"),
            *[F.avg(F.col(s).cast("double")).alias(f"avg_{s}") for s in scores],
        )
        .withColumn(level, F.when(F.col("__all") == 1, F.lit("ALL")).otherwise(F.col(level)))
        .drop("__all")
    )


def status_share(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status and their percentage of all rows."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(status, "n", (F.col("n") * 100.0 / total).alias("percent"))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose array of missing items is not empty, per column."""
    return df.agg(
        *[
            F.coalesce(F.sum(F.when(F.size(c) > 0, 1).otherwise(0)), F.lit(0)).alias(c)
            for c in columns
        ]
    )


def first_examples(
    df: DataFrame, key: str = "id", level: str = "level", correct: str = "exec_ok", n: int = EXAMPLES
) -> DataFrame:
    """First correct and first incorrect record of every level, filled up in key
    order to n records.  Only keys are compared, so no group is ever sorted."""
    firsts = df.groupBy(level, correct).agg(F.min(key).alias(key))
    chosen = firsts.select(
        key, level, correct, F.lit(0).alias("filler")
    )
    # the n + |chosen| smallest keys surely hold n that were not chosen
    many = df.select(key, level, correct).orderBy(key).limit(2 * n)
    filler = many.join(chosen.select(key), key, "left_anti").withColumn("filler", F.lit(1))
    return (
        chosen.unionByName(filler)
        .orderBy("filler", F.when(F.col("filler") == 0, F.col(level)), F.when(F.col("filler") == 0, ~F.col(correct)), key)
        .limit(n)
    )
