"""Layer profile: schema, descriptions, marks, row count and sample values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import iso_text
from ..sources.layers import sample_rows

# Columns marked as indexed, and the one to keep out of SELECT *.
INDEXED = ("GEOID", "STATEFP", "COUNTYFP", "COUNTYFIPS", "geometry")
AVOID_SELECT_STAR = ("geometry",)


def _as_text(field: T.StructField):
    c = F.col(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return F.concat(F.lit("BLOB("), F.octet_length(c).cast("string"), F.lit(" bytes)"))
    if isinstance(field.dataType, T.TimestampType):
        return iso_text(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).cast("string")
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c) if not isinstance(field.dataType, T.ArrayType) else F.to_json(F.struct(c))
    return c.cast("string")


def row_text(key: str | Sequence[str]) -> Column:
    """What a sample is drawn by: a key column as text, or several columns with NULLs as words."""
    if isinstance(key, str):
        return F.col(key).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in key])


def profile_layer(
    name: str, df: DataFrame, key: str | Sequence[str], descriptions: Mapping[str, str] | None = None, sample: int = 3
) -> DataFrame:
    """One row per column of a layer.

    ``sample`` holds a value of each sampled row in the order of the draw, the
    same for every column, NULL included, so the samples of a layer line up as
    rows.  ``key`` is a unique column, or all columns that tell rows apart.
    """
    descriptions = descriptions or {}
    count = df.agg(F.count(F.lit(1))).scalar()
    # at most ``sample`` rows reach the single aggregate below
    drawn = row_text(key)
    few = sample_rows(df, sample, drawn).select(
        F.md5(drawn).alias("__hash"), drawn.alias("__text"), *[_as_text(f).alias(f.name) for f in df.schema]
    )
    rows = F.array_sort(F.collect_list(F.struct(*few.columns)))
    one = few.agg(rows.alias("__rows")).select(
        *[F.col("__rows").getField(f.name).alias(f.name) for f in df.schema]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.lit(
                descriptions.get("geometry" if f.name == "geom" else f.name, "unknown")
            ).alias("description"),
            F.lit(f.name in INDEXED).alias("indexed"),
            F.lit(f.name in AVOID_SELECT_STAR).alias("avoid_select_star"),
            F.col(f.name).alias("sample"),
        )
        for i, f in enumerate(df.schema)
    ]
    return one.select(
        F.lit(name).alias("layer"), count.alias("row_count"), F.inline(F.array(*entries))
    )


def profile_layers(
    layers: Mapping[str, DataFrame],
    keys: Mapping[str, str | Sequence[str]],
    descriptions: Mapping[str, Mapping[str, str]] | None = None,
    sample: int = 3,
) -> DataFrame:
    """Profile of the layers named in ``keys`` (layer -> key column or columns)."""
    out = None
    for name, key in keys.items():
        one = profile_layer(name, layers[name], key, (descriptions or {}).get(name), sample)
        out = one if out is None else out.unionByName(one)
    return out
