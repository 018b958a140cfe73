"""Geometries that occur more than once.

Layers hold many copies of a geometry: facilities at one address, outlines drawn
again for every event.  A join whose pairs are only counted, summed or looked for
need not see them one by one.  ``once`` keeps a row for every different geometry
with the number of rows it stands for; ``code`` finds the rows of a geometry again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written


def code(geom) -> dict[str, Column]:
    """Columns that tell a geometry apart: 128 bits over an outline and the lengths of its rings, or the coordinates."""
    if not isinstance(geom, str):
        return {f"__code{i}": F.col(c) for i, c in enumerate(geom)}
    # hashes run through nested arrays and do not see where a ring ends
    lengths, outline = F.transform(F.col(geom)["rings"], F.size), F.col(geom)
    return {"__code0": F.xxhash64(lengths, outline), "__code1": F.xxhash64(F.lit(17), lengths, outline)}


def located(df: DataFrame, geom) -> DataFrame:
    """Rows that have a geometry."""
    known = [f"{geom}.xmin", f"{geom}.ymin"] if isinstance(geom, str) else geom
    return df.where(" AND ".join(f"{c} IS NOT NULL" for c in known))


def once(df: DataFrame, geom, keys: Sequence[str] = (), count: str = "__n") -> DataFrame:
    """A stored row for every different geometry (and ``keys``), with the number of rows it stands for."""
    columns = [geom] if isinstance(geom, str) else list(geom)
    grouped = located(df, geom).groupBy(*dict.fromkeys([*columns, *keys])).agg(F.count(F.lit(1)).alias(count))
    return written(grouped, "once")
