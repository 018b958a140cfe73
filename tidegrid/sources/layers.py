"""Layer loading: parquet layers, geometry decode, stored layout, views."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from ..operators.validity import with_geometry

# File-name suffixes of the three-state extract.
EXTRACT_SUFFIXES = ("_tx_fl_la", "_TX_FL_LA")


def layer_name(path: str) -> str:
    """Logical name of a layer file or directory."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    name = name.removesuffix(".parquet")
    for suffix in EXTRACT_SUFFIXES:
        name = name.removesuffix(suffix)
    return name


# -- WKB ---------------------------------------------------------------------

def _rings_from_wkb(data: bytes | None):
    """Oriented rings of a Polygon or MultiPolygon in WKB, None for points and lines; other types raise an error.

    Z and M, by ISO codes or EWKB flags, are stepped over.
    """
    if data is None:
        return None

    def polygon(at, order, dims):
        (n_rings,) = struct.unpack_from(order + "I", data, at)
        at += 4
        rings = []
        for k in range(n_rings):
            (n,) = struct.unpack_from(order + "I", data, at)
            xy = np.frombuffer(data, dtype=order + "f8", count=dims * n, offset=at + 4).reshape(n, dims)[:, :2]
            at += 4 + 8 * dims * n
            if n:
                x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
                twice = float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))
                if (twice > 0) != (k == 0):
                    xy = xy[::-1]
            rings.append([{"x": px, "y": py} for px, py in xy.tolist()])
        return rings, at

    def geometry(at):
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        iso, base = divmod(kind & 0x1FFFFFFF, 1000)
        if iso:
            dims = {1: 3, 2: 3, 3: 4}.get(iso)
        if dims is None or not 1 <= base <= 6:
            raise ValueError(f"WKB type {kind} is not decoded")
        if base not in (3, 6):
            return None, at
        if base == 3:
            return polygon(at, order, dims)
        (parts,) = struct.unpack_from(order + "I", data, at)
        at, rings = at + 4, []
        for _ in range(parts):
            more, at = geometry(at)
            rings += more
        return rings, at

    return geometry(0)[0]


@F.pandas_udf(g.RINGS_TYPE)
def rings_from_wkb(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Decode a binary WKB column to oriented rings."""
    for batch in values:
        yield batch.map(_rings_from_wkb)


@F.pandas_udf(T.BinaryType())
def wkb_from_rings(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Encode oriented rings as a WKB multipolygon: a shell and the holes after it are one part."""

    def encode(rings):
        if rings is None:
            return None
        parts = []
        for ring in rings:
            xy = np.array([(p["x"], p["y"]) for p in ring], "<f8").reshape(-1, 2)
            x, y = (xy - xy[:1]).T
            hole = float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) < 0
            data = struct.pack("<I", len(xy)) + xy.tobytes()
            if hole and parts:
                parts[-1].append(data)
            else:
                parts.append([data])
        body = b"".join(struct.pack("<BII", 1, 3, len(p)) + b"".join(p) for p in parts)
        return struct.pack("<BII", 1, 6, len(parts)) + body

    for batch in values:
        yield batch.map(encode)


# -- loading and layout ------------------------------------------------------

def load_layer(
    spark: SparkSession, path: str, geometry: str | None = None, key: Iterable[str] = ("GEOID",)
) -> DataFrame:
    """Read one parquet layer.

    With ``geometry`` naming a WKB column it is decoded and checked once; store
    the result with :func:`write_layer`.  A layer that already holds the
    geometry struct is read as it is.
    """
    df = spark.read.parquet(path)
    if geometry is None or dict(df.dtypes)[geometry] != "binary":
        return df
    decoded = df.withColumn("__decoded", rings_from_wkb(F.col(geometry))).drop(geometry)
    return with_geometry(decoded, list(key), "__decoded", geometry)


def write_layer(
    df: DataFrame,
    path: str,
    geometry: str = "geometry",
    key: Iterable[str] = ("GEOID",),
    cell: float = 0.25,
    files: int | None = None,
) -> None:
    """Store a polygon layer so that bounds filters skip row groups.

    Rows are range-partitioned and sorted by grid cell; the key's hash breaks
    ties, so a crowded cell spreads over several files.  The rows are staged
    next to ``path`` first, because a range partitioning reads its input twice.
    """
    staging = f"{path}-staging"
    df.write.mode("overwrite").parquet(staging)
    df = df.sparkSession.read.parquet(staging)
    box = F.col(geometry)
    order = [
        F.floor(box["xmin"] / cell), F.floor(box["ymin"] / cell), F.xxhash64(*key)
    ]
    ranged = (
        df.repartitionByRange(*order) if files is None else df.repartitionByRange(files, *order)
    )
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def list_layers(spark: SparkSession, directory: str) -> dict[str, str]:
    """Layer name -> path for every parquet file or folder in a directory."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [str(s.getPath().toString()) for s in fs.listStatus(hadoop)]
    return {layer_name(p): p for p in sorted(paths) if p.endswith(".parquet")}


def open_layers(
    spark: SparkSession,
    directory: str,
    names: Iterable[str] | None = None,
    geometry: Mapping[str, tuple[str, list[str]]] | None = None,
) -> dict[str, DataFrame]:
    """All layers of a directory, or the named ones; a missing file is an error.

    ``geometry`` maps a layer to (WKB column, key columns).
    """
    found = list_layers(spark, directory)
    wanted = list(names) if names is not None else list(found)
    missing = [n for n in wanted if n not in found]
    if missing:
        raise FileNotFoundError(f"no parquet file for layers: {', '.join(missing)}")
    geometry = geometry or {}
    return {
        n: load_layer(spark, found[n], *geometry.get(n, (None, ["GEOID"]))) for n in wanted
    }


def register_views(layers: Mapping[str, DataFrame]) -> list[str]:
    """Expose every layer as a temporary view under its name."""
    for name in layers:
        layers[name].createOrReplaceTempView(name)
    return list(layers)


# -- catalog -----------------------------------------------------------------

def describe_schema(layers: Mapping[str, DataFrame], spark: SparkSession) -> DataFrame:
    """layer, position, column, type of every layer (schema only, no scan)."""
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name in layers
        for i, field in enumerate(layers[name].schema)
    ]
    return spark.createDataFrame(
        rows, "layer string, position int, column_name string, column_type string"
    )


def list_columns(layers: Mapping[str, DataFrame], names: Iterable[str]) -> dict[str, list[str] | None]:
    """Columns of the chosen layers, None for a layer that is missing."""
    return {n: layers[n].columns if n in layers else None for n in names}


def row_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """layer, row_count."""
    frames = [
        layers[n].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("layer"), "row_count"
        )
        for n in layers
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def sample_rows(df: DataFrame, n: int, key: Column | str) -> DataFrame:
    """n rows in hash order of a key: looks random, comes out the same every run."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    return df.orderBy(F.md5(text), text).limit(n)
