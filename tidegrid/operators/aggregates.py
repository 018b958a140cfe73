"""Aggregation patterns of the workload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def top_n(df: DataFrame, keys: Sequence[str], measure: Column, n: int, ascending: bool = False) -> DataFrame:
    """Keys of the n groups with the largest aggregate; ties go by key.

    The measure itself is not part of the result.
    """
    ranked = df.groupBy(*keys).agg(measure.alias("__measure"))
    order = F.col("__measure").asc_nulls_last() if ascending else F.col("__measure").desc_nulls_last()
    return ranked.orderBy(order, *keys).limit(n).select(*keys)


def weighted_mean(df: DataFrame, keys: Sequence[str], x: Column, w: Column, name: str = "weighted_mean") -> DataFrame:
    """sum(x*w) / sum(w) per key."""
    return (
        df.groupBy(*keys)
        .agg(F.sum(x * w).alias("__xw"), F.sum(w).alias("__w"))
        .select(*keys, F.try_divide("__xw", "__w").alias(name))
    )


def annual_mean(df: DataFrame, date: str, keys: Sequence[str] = (), name: str = "annual_mean") -> DataFrame:
    """Rows per year of the inclusive span from the first to the last dated year."""
    year = F.year(date)
    span = (F.max(year) - F.min(year) + 1).cast("double")
    return df.groupBy(*keys).agg(F.try_divide(F.count(date).cast("double"), span).alias(name))


def extent(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Bounding rectangle of a whole layer."""
    box = F.col(geom)
    return df.agg(
        F.min(box["xmin"]).alias("xmin"), F.min(box["ymin"]).alias("ymin"),
        F.max(box["xmax"]).alias("xmax"), F.max(box["ymax"]).alias("ymax"),
    )


def coverage_share(pairs: DataFrame, keys: Sequence[str], geom: str, area: str, name: str = "share") -> DataFrame:
    """Summed overlap area per polygon divided by the polygon's own area.

    Overlaps of stacked partners add up; they are not unioned.
    """
    own = pairs.withColumn("__own", g.polygon_area(geom))
    return (
        own.groupBy(*keys)
        .agg(F.sum(area).alias("__sum"), F.first("__own").alias("__own"))
        .select(*keys, F.try_divide("__sum", "__own").alias(name))
    )


def weighted_avg(value: Column, weight: Column) -> Column:
    """Aggregate: mean of a value that stands for ``weight`` joined rows.

    Lets a join with many partners be counted per key first and still give the
    mean over all joined rows.
    """
    present = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.sum(present).cast("double"))
